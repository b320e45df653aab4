"""Batch operators: profiling, quality, relationships, metrics, data tests, text rules, run events."""
