"""Distributed static analysis and corpus processing on Spark."""
