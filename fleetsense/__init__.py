"""Usage records in, failure warnings out: asset-failure analytics as Spark DataFrame functions."""
