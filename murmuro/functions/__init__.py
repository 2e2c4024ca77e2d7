"""Column expressions built from JVM functions."""
