"""Table checking and preparation as Spark jobs."""
