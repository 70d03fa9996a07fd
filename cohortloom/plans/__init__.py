"""Registered queries: the operators over the driver tables."""
