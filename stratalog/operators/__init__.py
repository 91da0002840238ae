"""Versioned reads, audits, and changes of tables."""
