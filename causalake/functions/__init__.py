"""Column expressions: text keys, scores, molecules, proteins. All run inside the JVM."""
