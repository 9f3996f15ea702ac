"""Operators for large text and pair corpora; nothing outside this subpackage imports it."""
