"""Whole jobs from source tables to written results."""
