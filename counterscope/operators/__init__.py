"""Transforms over snapshots and deltas."""
