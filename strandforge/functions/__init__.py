"""Column builders: JVM-side expressions without state, usable in batch and streaming plans."""
