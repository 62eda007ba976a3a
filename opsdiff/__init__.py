"""Change and regression analytics over fleets of machines, on Spark."""
