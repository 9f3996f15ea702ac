"""Sinks of hitloom."""
