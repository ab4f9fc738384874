"""Column-level building blocks: every function here returns a Column and stays in the JVM."""
