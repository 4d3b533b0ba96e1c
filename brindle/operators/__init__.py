"""Relational operators on DataFrames, table-valued APPLY, and writes as rewrites of DataFrames."""
