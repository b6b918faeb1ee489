"""Operators that prepare language-model training data, and their registered queries."""
