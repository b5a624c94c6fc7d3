"""Column-expression builders. Everything here runs inside the JVM."""
