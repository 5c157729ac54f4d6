"""Operators for training-data pipelines; nothing else in keyfold imports this package."""
