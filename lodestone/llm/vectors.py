"""Which rows of a table of vectors take part, for the operators on embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, column: str = "embedding", zero: bool = True) -> DataFrame:
    """Rows whose vector is no null and holds numbers only (neither null, NaN nor infinite), and is not all zero unless `zero`.

    Vectors of one table have one length: of several lengths the most frequent
    counts (of equally many the greatest), and rows of the others are left out.
    """
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fit = rows.where(F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(F.forall(column, number), F.lit(False)))
    if not zero:
        fit = fit.where(F.exists(column, lambda x: x != 0))
    lengths = fit.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return fit.where(F.size(column) == (lengths["d"] if lengths else 0))
