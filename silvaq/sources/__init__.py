"""Readers, writers and derivations of token graphs."""
