"""Assembled pipelines and the registered queries."""
