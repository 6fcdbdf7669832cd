"""Readers, writers and connector interfaces."""
