"""Operators for training-data pipelines over statement texts and other documents."""
