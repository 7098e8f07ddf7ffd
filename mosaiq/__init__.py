"""Reproducibility and segmentation-scale evidence as Spark DataFrames."""
