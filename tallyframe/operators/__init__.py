"""Operators: each is a function DataFrame(s) -> DataFrame."""
