"""Registered queries, one for each operator, with their SQL."""
