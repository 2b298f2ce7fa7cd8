"""Operators for preparing training data: ten operators and their registered queries."""
