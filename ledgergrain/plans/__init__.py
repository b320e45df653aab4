"""Staging, intermediate and mart models, and the graph between them."""
