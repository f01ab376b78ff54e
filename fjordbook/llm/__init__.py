"""Operators for preparing training data: ten operators, each with its registered query."""
