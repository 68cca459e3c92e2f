"""Bars to windows, waves, patterns, statistics and trades."""
