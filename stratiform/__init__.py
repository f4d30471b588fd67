"""Spatiotemporal analytics as DataFrame transformations."""
