"""Structured Streaming forms: index appends, running analytics, click training, sessions."""
