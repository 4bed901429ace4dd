"""semtflow: Turkish address normalization and match-quality analytics on Spark."""
