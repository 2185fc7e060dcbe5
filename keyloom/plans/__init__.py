"""Whole pipelines: features, curation and evaluation."""
