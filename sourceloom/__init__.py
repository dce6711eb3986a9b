"""Source-code estate analytics as Spark DataFrame operators."""
