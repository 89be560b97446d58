"""DataFrame -> DataFrame operators; every result is lazy."""
