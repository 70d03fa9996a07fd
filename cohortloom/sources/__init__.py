"""Readers of raw formats and writers of results."""
