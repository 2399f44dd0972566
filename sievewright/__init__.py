"""Spark-native preparation and evaluation of question-answer text corpora."""
