"""Incremental reading of documents."""
