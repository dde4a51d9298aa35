"""Structured Streaming: change events, debounced re-analysis, running queue state."""
