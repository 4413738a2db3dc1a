"""Relational operators of the engine, one module a topic."""
