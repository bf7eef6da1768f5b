"""Lineage, checkpoint folders and bounded broadcasts."""
