"""Marketplace product analytics as Spark DataFrame operators."""
