"""Relational, graph and ranking operators over lazy tables."""
