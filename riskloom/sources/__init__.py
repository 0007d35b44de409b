"""Readers, sinks and the versioned feature store."""
