"""Whole queries over the engine tables."""
