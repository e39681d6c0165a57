"""Checking statements against records, and preparing corpora, with Spark DataFrames."""
