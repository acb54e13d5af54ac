"""Dialogue and text analytics as Spark plans."""
