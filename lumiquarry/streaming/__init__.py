"""Watching folders and windows over event streams."""
