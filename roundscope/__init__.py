"""Round-based match telemetry analytics as Spark DataFrame transformations."""
