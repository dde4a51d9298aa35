"""Operators for preparing training text: mixing, counting, joining, filtering, scoring, encoding."""
