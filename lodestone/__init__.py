"""Fact and document analytics on Spark."""
