"""Coresets of streams."""
