"""Scoring new documents as they arrive."""
