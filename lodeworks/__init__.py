"""Spark-native data mining: every operator takes DataFrames and returns DataFrames."""
