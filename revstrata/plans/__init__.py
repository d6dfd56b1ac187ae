"""Queries over the engine's operators, each with its SQL where SQL can express it."""
