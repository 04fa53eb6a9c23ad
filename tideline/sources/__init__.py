"""Mapping of landed payloads to postings, and outcomes of the fetches."""
