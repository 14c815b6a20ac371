"""Samples from snapshots that keep arriving."""
