"""aerolith: aerial-survey analytics expressed as Spark DataFrame operators."""
