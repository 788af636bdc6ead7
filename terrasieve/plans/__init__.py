"""Query catalogue: what ``__spark_entry__`` registers for the engine's own operators."""
