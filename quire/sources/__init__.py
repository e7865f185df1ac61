"""Readers of document files and writers of results."""
