"""Array columns used as vectors."""

from pyspark.sql import functions as F


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def norm(a):
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def squared_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)),
                       F.lit(0.0), lambda s, x: s + x)


def normalised(a, floor=1e-12):
    """Unit-length vector; a vector shorter than ``floor`` is divided by ``floor``."""
    size = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x.cast("double") / size)


def minus(a, b):
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def scaled(a, factor):
    return F.transform(a, lambda x: x.cast("double") * factor)


def uniform(*keys):
    """Deterministic number in [0, 1): the first 48 bits of the md5 of the key texts."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
