"""Spark-native text annotation, feature and corpus-preparation engine."""
