"""Streams of changes into tables of sessions."""
