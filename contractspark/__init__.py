"""Contract-extraction datasets on Spark: build, clean, split, chunk, merge and score."""
