"""Column helpers. Everything here is a built-in expression; there is no Python UDF."""
