"""The same operators over Structured Streaming micro-batches."""
