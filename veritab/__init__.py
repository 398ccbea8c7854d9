"""Entity-centric data standardization on Spark."""
