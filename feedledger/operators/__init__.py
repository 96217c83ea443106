"""DataFrame operators of an incremental collection run."""
