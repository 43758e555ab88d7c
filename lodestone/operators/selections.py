"""Row selections of studies: by role, condition, order and first occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_role(rows: DataFrame, roles: DataFrame, key: str, role: str, value: str) -> DataFrame:
    """Rows whose key has a role in another table."""
    return rows.join(roles.where(F.col(role) == value).select(key), key, "left_semi")


def keep_conditions(rows: DataFrame, chosen: DataFrame, keys: list[str], sham: Column) -> DataFrame:
    """Rows of chosen conditions, and all that are shams."""
    marked = rows.join(chosen.select(*keys).distinct().withColumn("_in", F.lit(True)), keys, "left")
    return marked.where(sham | F.col("_in").isNotNull()).drop("_in")


def excluded_conditions(rows: DataFrame, chosen: DataFrame, keys: list[str], sham: Column) -> DataFrame:
    """keys, n: how many rows keep_conditions leaves out of each condition."""
    return rows.where(~sham).join(chosen.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.count("*").alias("n"))


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of every key in order, by an aggregate, so that no key's rows are sorted in one task."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("_key")).agg(first.alias("_row")).select("_row.*")


def strongest(rows: DataFrame, by: list[str], ordinal: str, name: str) -> DataFrame:
    """by, name of the largest ordinal."""
    return rows.groupBy(*by).agg(F.max_by(name, ordinal).alias(name))


def pilot(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """The n rows of the smallest key (a hash): a top-k, never a full sort."""
    return rows.withColumn("_k", key).orderBy("_k").limit(n).drop("_k")


def firsts_of(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first row of every combination of by, n combinations at most, in the order of by."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n").orderBy(*by).limit(n)


def eligible_partners(rows: DataFrame, id: str, group: str, content: str, bits: str, key: str, distance: int) -> DataFrame:
    """id, partner: rows of one key that differ in id, group, content and in more than so many bits; for candidates that are few a key."""
    a, b = rows.alias("a"), rows.alias("b")
    apart = [F.col(f"a.{c}") != F.col(f"b.{c}") for c in (id, group, content)]
    far = F.bit_count(F.col(f"a.{bits}").bitwiseXOR(F.col(f"b.{bits}"))) > distance
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).where(apart[0] & apart[1] & apart[2] & far).select(F.col(f"a.{id}").alias(id), F.col(f"b.{id}").alias("partner"))


def validations(events: DataFrame, kind: str, value: str, bounded: str) -> DataFrame:
    """Events of a kind that are not marked as bounded; a missing mark is none."""
    return events.where((F.col(kind) == value) & ~F.coalesce(F.col(bounded).cast("boolean"), F.lit(False)))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose output does not exist yet."""
    return wanted.join(done.select(key), key, "left_anti")


def ordered_pairs(members: DataFrame, name: str, order: str) -> DataFrame:
    """first, second: every two members, the one that comes first in the declared order first."""
    a, b = members.alias("a"), members.alias("b")
    return a.join(b, F.col(f"a.{order}") < F.col(f"b.{order}")).select(F.col(f"a.{name}").alias("first"), F.col(f"b.{name}").alias("second"))
