"""Result and graph operators over DataFrames."""
