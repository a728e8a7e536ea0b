"""Cluster a text corpus on Spark and explain the clusters."""
