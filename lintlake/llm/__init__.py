"""Operators for training data: everything below this package stands apart from the rest of the engine."""
