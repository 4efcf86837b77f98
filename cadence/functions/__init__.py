"""Column builders: everything here stays in the JVM."""
