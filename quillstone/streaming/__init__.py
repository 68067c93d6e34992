"""Event streams on Structured Streaming."""
