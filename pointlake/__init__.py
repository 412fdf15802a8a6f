"""pointlake: collections of dense float32 vectors with schemaless payloads, as DataFrame plans on Spark."""
