"""The polled computations as Structured Streaming queries."""
