"""Spark-native frame analytics: moving-object detection over DataFrames of frames."""
