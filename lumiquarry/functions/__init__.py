"""Column expressions: scores, geometry, vectors, texts and arrays, all inside the JVM."""
