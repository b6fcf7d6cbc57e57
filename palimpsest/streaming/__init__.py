"""Tables as sinks of Structured Streaming."""
