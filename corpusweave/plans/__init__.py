"""Whole experiments, their settings, and the catalogue of checked queries."""
