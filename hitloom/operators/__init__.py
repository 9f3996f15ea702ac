"""Operators of hitloom."""
