"""Support-issue analytics as Spark DataFrame operators."""
