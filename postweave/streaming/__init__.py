"""The stateful operators on Structured Streaming: the same transformations as in batch, with remembered state."""
