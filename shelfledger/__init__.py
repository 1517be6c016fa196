"""Retail store analytics as lazy Spark DataFrame plans."""
