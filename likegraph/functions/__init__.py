"""Transforms of raw feature blocks."""
