"""Foliant: contact and document analytics as PySpark plans."""
