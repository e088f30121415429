"""The stream checks as Structured Streaming queries."""
