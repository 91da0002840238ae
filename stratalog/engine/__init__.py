"""Mutable tables over append-only change logs."""
