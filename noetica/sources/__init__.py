"""Readers and views."""
