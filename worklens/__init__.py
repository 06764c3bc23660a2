"""Spark-native record linkage and screening of public-works spending."""
