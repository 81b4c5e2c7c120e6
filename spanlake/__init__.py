"""spanlake: corpus analytics over annotated text, as Spark DataFrame transforms."""
