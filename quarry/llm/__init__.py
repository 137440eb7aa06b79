"""Operators for building large training corpora (each module is one operator)."""
