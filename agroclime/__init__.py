"""Crop-production and rainfall analytics as DataFrame-to-DataFrame operators."""
