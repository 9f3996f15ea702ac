"""Streaming of hitloom."""
