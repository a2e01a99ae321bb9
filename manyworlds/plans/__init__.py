"""Session-level planning helpers: checkpoints, size checks, partition counts."""
