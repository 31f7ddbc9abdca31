"""Functions for SQL: table functions over documents."""
