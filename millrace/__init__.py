"""Millrace: a retail data warehouse as Spark batch and streaming jobs."""
