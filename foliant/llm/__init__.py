"""Operators for preparing training data from parsed documents."""
