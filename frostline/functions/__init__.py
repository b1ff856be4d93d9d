"""Column builders shared by every operator; all of them stay inside generated JVM code."""
