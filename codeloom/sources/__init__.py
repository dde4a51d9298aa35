"""Reading and writing: file corpora, append-only logs and the queue tables."""
