"""sampleloom: annotated-matrix analytics and data preparation as Spark plans."""
