"""Column helpers shared by the engine."""
