"""Spark-first engine for building and querying a catalogue of tracks and their texts."""
