"""Detectors over history rows. Each takes (history, as_of, config) and returns signal rows."""
