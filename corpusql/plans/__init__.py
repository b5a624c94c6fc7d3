"""Question classes as relational plans over ordinary tables."""
