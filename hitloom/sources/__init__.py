"""Sources of hitloom."""
