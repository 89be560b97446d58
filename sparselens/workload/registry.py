"""Name -> query, name -> SQL, filled by the query modules."""

from pyspark.sql import functions as F

from sparselens.workload import frames

QUERIES, SQL = {}, {}


def register(name, tables=None, sql=None):
    """Add a query; ``sql`` is its SQL body over ``tables`` of the frames module."""
    def keep(fn):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = frames.sql(tables or "", sql)
        return fn
    return keep


def rounded(df, *columns, digits=6):
    """Round for comparison; +0.0 turns a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def joined(df, *columns, sep=","):
    """Arrays as text, for comparison."""
    return df.withColumns({c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), sep)
                           for c in columns})
