"""Streaming bars."""
