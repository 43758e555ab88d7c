"""Functions for SQL text: expressions as SQL functions, and conditions and draws as table functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lodestone.operators.pairs import SEVERITIES, STRENGTH

EXPRESSIONS = {
    "lodestone_entropy(p ARRAY<DOUBLE>) RETURNS DOUBLE": "-aggregate(p, 0D, (a, x) -> a + if(x > 0, x * ln(x), 0D))",
    "lodestone_hamming(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
    "lodestone_digest(a STRING, b STRING) RETURNS STRING": "sha2(concat(a, char(0), b), 256)",
    "lodestone_safe_path(p STRING) RETURNS BOOLEAN": r"p <> '' AND NOT p RLIKE '\\A/|(\\A|/)[.][.](/|\\z)|[:\\\\\\x00]'",
}


@udtf(returnType="family string, severity string, ordinal int, strength double")
class Conditions:
    """Every family at every severity."""

    def eval(self):
        for family, strengths in STRENGTH.items():
            for ordinal, severity in enumerate(SEVERITIES):
                yield family, severity, ordinal, strengths[severity]


@udtf(returnType="slot bigint, number bigint")
class Draws:
    """n draws with replacement from n groups for one replicate of a seed, by hash."""

    def eval(self, seed: int, replicate: int, n: int):
        for slot in range(n):
            h = hashlib.sha256("\0".join(map(str, (seed, replicate, slot))).encode()).hexdigest()
            yield slot, int(h[:16], 16) % n


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session under names that begin with lodestone_."""
    for head, body in EXPRESSIONS.items():
        name, rest = head.split("(", 1)
        arguments, kind = rest.rsplit(") RETURNS ", 1)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("lodestone_conditions", Conditions)
    spark.udtf.register("lodestone_draws", Draws)
