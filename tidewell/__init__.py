"""Spark-native analytics over robot-episode trajectories, annotations and curation records."""
