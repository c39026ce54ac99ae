"""Shelf: product-catalogue analytics as Spark DataFrame jobs."""
