"""Filters, projections, block summaries and reports over log records."""
