"""Column expressions and closed forms: pixels, geometry, windows."""
