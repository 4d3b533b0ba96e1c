"""Scalar functions, casts and aggregates with the engine's semantics, as Column builders."""
