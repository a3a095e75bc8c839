"""Marketplace customer-experience analytics on PySpark DataFrames."""
