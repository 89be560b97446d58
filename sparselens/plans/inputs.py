"""How an input is spread over tasks."""

from sparselens.plans.joins import is_small


def spread(df):
    """Spread a small single-table input over all cores before a step that is heavy per row.

    A small table is often one file and would run in one task. Large inputs already come in
    many splits and are left where they are, and so are streams and results of joins.
    """
    if df.isStreaming or not is_small(df):
        return df
    tables = df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    return df if tables > 1 else df.repartition(df.sparkSession.sparkContext.defaultParallelism)
