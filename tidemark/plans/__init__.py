"""Requests, their validation, and how a search is carried out."""
