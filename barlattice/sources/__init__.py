"""Readers, sinks and the mapping of stored tables to the market model."""
