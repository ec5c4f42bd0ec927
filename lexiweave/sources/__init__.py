"""Readers of the engine's source formats."""
