"""Mobility analytics and table operators written for Spark's DataFrame API."""
