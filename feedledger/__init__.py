"""feedledger: incremental collection tables on Spark."""
