"""Evidence analytics on Spark: sampled streams, event logs, observations and trees in; statuses with their reasons out."""
