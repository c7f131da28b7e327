"""Kontor: a Spark-first engine for company-data queries."""
