"""tallyvox: product-review analytics as Spark jobs."""
