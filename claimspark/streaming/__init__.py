"""The log as a stream, and the outbox that its effects pass through."""
