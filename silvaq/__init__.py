"""silvaq: a PySpark-native search and analytics engine for token graphs."""
