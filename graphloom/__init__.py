"""Graph-pattern analytics as lazy Spark DataFrame plans."""
