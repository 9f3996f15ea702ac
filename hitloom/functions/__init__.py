"""Functions of hitloom."""
