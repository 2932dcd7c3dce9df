"""Multi-operator study flows."""
