"""Feature planning and whole pipelines."""
