"""Tidemark: a log store and text-preparation engine on Spark."""
