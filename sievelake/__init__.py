"""Spark-native document library analytics: exact and near duplicate detection, review and lifecycle."""
