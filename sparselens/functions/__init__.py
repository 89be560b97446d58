"""Column functions: no joins, no shuffles, JVM-side only."""
