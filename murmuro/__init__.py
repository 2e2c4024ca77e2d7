"""Spark-native analytics for speech-token data: segments, spans, metrics, shards and texts."""
