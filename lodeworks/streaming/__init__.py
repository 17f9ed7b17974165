"""Streaming forms of the event analytics: an extension, since the reference semantics are batch only."""
