"""Prospect analytics on Spark: DataFrame operators for energy and earth-observation tables."""
