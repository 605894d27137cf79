"""quern: document matching and procurement analytics as plain Spark DataFrame operators."""
