"""Composed dataflows and the query catalogue."""
