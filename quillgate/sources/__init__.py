"""Scans and intake checks."""
