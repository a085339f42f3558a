"""Readers and download control."""
