"""Plan-shaping building blocks shared by the operators."""
