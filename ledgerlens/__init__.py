"""Filing analytics as Spark DataFrame transformations."""
