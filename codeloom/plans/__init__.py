"""Operators composed into whole analyses."""
