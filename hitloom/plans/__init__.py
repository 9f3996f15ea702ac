"""Plans of hitloom."""
