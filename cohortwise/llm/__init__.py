"""Operators of a training-data pipeline: filtering, joining, scoring and packing of documents."""
