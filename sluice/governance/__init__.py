"""Controls that a question passes before any Spark task starts."""
