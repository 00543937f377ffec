"""Schemas, readers, sinks and the adapter over the test tables."""
