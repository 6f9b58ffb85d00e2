"""Operators for preparing training data at scale. Nothing else in silvaq imports this subpackage."""
