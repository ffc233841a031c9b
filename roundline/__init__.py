"""Event-timeline analytics on Spark: readings to rounds, matches and metrics."""
