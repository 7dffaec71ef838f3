"""Resumable work as file streams."""
