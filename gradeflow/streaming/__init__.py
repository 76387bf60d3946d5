"""Structured Streaming jobs. Each writes versions that a batch read folds to the newest state."""
