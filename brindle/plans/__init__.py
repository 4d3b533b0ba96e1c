"""Statements, the catalogue, and the registered queries."""
