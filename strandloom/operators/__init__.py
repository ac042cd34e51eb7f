"""Operators over sequences and their index."""
