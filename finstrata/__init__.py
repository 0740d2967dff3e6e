"""Spark-native analytics over corporate disclosures: DataFrame in, DataFrame out."""
