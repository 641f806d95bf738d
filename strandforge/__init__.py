"""strandforge: dataset preparation for sequence and small-molecule learning, as Spark plans."""
