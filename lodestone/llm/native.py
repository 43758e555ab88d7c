"""Column helpers that the operators without user functions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"  # what separates words
STRIPPED = "\t\n\x0b\x0c\r "  # what is stripped from lines
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inlined twice, an array expression would be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that rows do not have."""
    while name.lower() in map(str.lower, rows.columns):
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the fast built-in serves where no character beyond ASCII and ß-ÿ occurs."""
    return F.when(text.rlike(r"[^\x00-\x7Fß-ÿ]"), F.translate(text, CAPITALS, CAPITALS.lower())).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Array of the words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def starts_of(lengths: Column) -> Column:
    """Running sums before each element of an array of lengths, by blocks of 64: no square of the length."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    blocks = lambda xs: F.transform(F.sequence(F.lit(0), (F.size(xs) / 64).cast("int")), lambda b: F.slice(xs, b * 64 + 1, F.lit(64)))
    before = lambda xs: F.transform(xs, lambda _, i: total(F.slice(xs, F.lit(1), i)))

    def placed(parts: Column, base: Column) -> Column:
        inside = lambda part, b: F.transform(part, lambda _, i: F.get(base, b) + total(F.slice(part, F.lit(1), i)))
        return F.flatten(F.transform(parts, inside))

    sums = lambda parts: let(F.transform(parts, total), lambda each: let(F.transform(blocks(each), total), lambda upper: let(before(upper), lambda u: placed(blocks(each), u))))
    return let(lengths, lambda xs: let(blocks(xs), lambda parts: let(sums(parts), lambda base: placed(parts, base))))


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """Number of the sorted bounds below value (null: 0), by bisection in one constant array."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    steps = [1 << b for b in range((len(bounds)).bit_length() - 1, -1, -1)]
    count = lambda t: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.get(t, at + step - 1) < value, step).otherwise(0))
    return F.when(value.isNull(), F.lit(0)).otherwise(let(table, count))
