"""Sinks: what the engine writes for others to read."""
