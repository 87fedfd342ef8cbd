"""Marketplace research on Spark DataFrames: pages, products, reviews, keywords."""
