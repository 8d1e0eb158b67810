"""loomstate: Spark-first analytics over ordered logs of state changes."""
