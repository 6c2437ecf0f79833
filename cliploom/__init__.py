"""Multimodal clip analytics on Spark DataFrames."""
