"""Spatial risk analytics as ordinary Spark DataFrames."""
