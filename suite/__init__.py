"""Registered queries: the library's operators bound to the driver's tables, with their SQL."""
