"""Spark-native analytics for exam-practice data and training corpora."""
