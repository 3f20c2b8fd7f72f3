"""Composite reports built from several operators."""
