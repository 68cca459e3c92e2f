"""Readers and writers of bars, symbols, manifests, patterns and trades."""
