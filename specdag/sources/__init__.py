"""Tables, snapshots and write plans."""
