"""Column-level building blocks: fixed values, text helpers and rule lookups."""
