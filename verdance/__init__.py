"""Spark-native analytics for repeated-sample evaluations of generative models."""
