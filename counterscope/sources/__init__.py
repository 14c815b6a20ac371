"""Where snapshots and servers come from."""
