"""Column-level building blocks: no shuffle, no action."""
