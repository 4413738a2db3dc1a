"""Readers and the mapping of plain tables to logs and graphs."""
