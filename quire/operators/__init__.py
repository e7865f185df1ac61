"""Operators on frames of documents."""
