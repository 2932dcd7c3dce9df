"""Column-level building blocks (no actions, no joins)."""
