"""Catalog price and stock tracking as Spark DataFrame functions."""
