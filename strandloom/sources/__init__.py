"""Readers, sinks and shared working tables."""
