"""Distribution functions and small numeric solvers."""
