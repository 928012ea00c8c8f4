"""Column helpers. Every function takes and returns Columns and stays inside JVM expressions."""
