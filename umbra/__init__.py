"""umbra: privacy-preserving transformations as plain Spark DataFrame operators."""
