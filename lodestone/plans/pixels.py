"""Registered queries over images: embeddings as 3 x 8 x 8 tensors, changed, resized, encoded, decoded, hashed and cached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.operators import attention, images, pairs
from lodestone.plans.catalogue import _no_zero, query, table
from lodestone.sources import cache, nested
from lodestone.storage import shared_dir

SIDE = 8
SIZES = {"sham": 8, "mild": 6, "moderate": 4, "severe": 2}  # inner sizes of the resolution family


def tensors(spark, d) -> DataFrame:
    """vec_id, image: of a representation of 64 numbers the channels (e + 1) / 2, its complement, and itself backwards."""
    level = F.transform("embedding", lambda x: (x.cast("double") + 1) / 2)
    flat = F.concat(level, F.transform(level, lambda v: 1 - v), F.reverse(level))
    return table(spark, d, "embeddings").select("vec_id", images.from_vector(flat, 3, SIDE, SIDE).alias("image"))


_PX = """e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
 px AS MATERIALIZED (SELECT vec_id, 0 AS c, i // 8 AS y, i % 8 AS x, (v + 1) / 2 AS v FROM e UNION ALL SELECT vec_id, 1, i // 8, i % 8, 1 - (v + 1) / 2 FROM e
  UNION ALL SELECT vec_id, 2, (63 - i) // 8, (63 - i) % 8, (v + 1) / 2 FROM e)"""


def _kernels(steps: list[tuple[int, int]]) -> str:
    """k(size, size_out, o, i, w): weights of a bicubic resampling that widens with the step."""
    cells = " UNION ALL ".join(f"SELECT {a} AS size, {b} AS size_out, o.o, i.i, {a} / {b}::DOUBLE AS step, greatest({a} / {b}::DOUBLE, 1) AS wide FROM range({b}) o(o), range({a}) i(i)" for a, b in steps)
    return f"""k0 AS (SELECT *, (o + 0.5) * step AS centre FROM ({cells})), k1 AS (SELECT *, abs((i + 0.5 - centre) / wide) AS t FROM k0 WHERE i >= greatest(floor(centre - 2 * wide + 0.5), 0) AND i < least(floor(centre + 2 * wide + 0.5), size)),
 k2 AS (SELECT size, size_out, o, i, CASE WHEN t < 1 THEN (1.5 * t - 2.5) * t * t + 1 WHEN t < 2 THEN -0.5 * (((t - 5) * t + 8) * t - 4) ELSE 0 END AS w FROM k1),
 k AS MATERIALIZED (SELECT size, size_out, o, i, w / sum(w) OVER (PARTITION BY size, size_out, o) AS w FROM k2)"""


_MASS = "round(sum({v} * ((y * {side} + x) * 7 % 13)), 6) + 0.0 AS mass"


def _mass(image: Column, channel: int, side: int = SIDE) -> Column:
    """Sum of a channel's values by weights of their places, so that a value in a wrong place shows."""
    part = F.slice(image["values"], channel * side * side + 1, side * side)
    return _no_zero(F.aggregate(F.transform(part, lambda v, i: v * (i * 7 % 13)), F.lit(0.0), lambda a, v: a + v))


def _by_channel(rows: DataFrame, image: str, *keys: str, side: int = SIDE) -> DataFrame:
    masses = F.array(*[F.struct(F.lit(c).alias("c"), _mass(F.col(image), c, side).alias("mass")) for c in range(3)])
    return rows.select(*keys, F.inline(masses))


def _changed(spark, d, family: str, strengths: dict[str, float]) -> DataFrame:
    rows = tensors(spark, d)
    both = pairs.neighbours(rows.withColumnRenamed("image", "e")).withColumnRenamed("e", "image")
    each = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(float(v)).alias("strength")) for s, v in strengths.items()])
    gains = F.transform(F.array(*map(F.lit, range(3))), lambda c: 1 + F.col("strength") * ((F.col("vec_id") * 31 + c * 17) % 101 / 50.5 - 1))
    changed = images.intervene(F.col("image"), F.col("d"), F.lit(family), F.col("strength"), gains)
    return both.select("vec_id", "image", "d", F.inline(each)).select("vec_id", "severity", changed.alias("image"))


def _values(levels: dict[str, float]) -> str:
    return "(VALUES " + ", ".join(f"('{s}', {float(v)}::DOUBLE)" for s, v in levels.items()) + ") s(severity, strength)"


@query(f"""WITH {_PX} SELECT vec_id, severity, c, {_MASS.format(v="greatest(least(v * (1 + strength * ((vec_id * 31 + c * 17) % 101 / 50.5::DOUBLE - 1)), 1), 0)", side=8)}
 FROM px, {_values(pairs.STRENGTH["gain"])} GROUP BY 1, 2, 3""")
def image_gains(spark, d):
    return _by_channel(_changed(spark, d, "gain", pairs.STRENGTH["gain"]), "image", "vec_id", "severity")


@query(f"""WITH {_PX}, n AS (SELECT vec_id, coalesce(lead(vec_id) OVER (ORDER BY vec_id), min(vec_id) OVER ()) AS donor FROM embeddings),
 g AS (SELECT u.u, v.v AS w, y.y, x.x, 2 * pi() * (u.u * y.y + v.v * x.x) / 8 AS a FROM range(8) u(u), range(8) v(v), range(8) y(y), range(8) x(x)),
 f AS MATERIALIZED (SELECT vec_id, c, u, w, sum(v * cos(a)) AS re, -sum(v * sin(a)) AS im FROM px JOIN g USING (y, x) GROUP BY 1, 2, 3, 4),
 m AS (SELECT f.vec_id, severity, f.c, f.u, f.w, (1 - strength) * sqrt(f.re * f.re + f.im * f.im) + strength * sqrt(o.re * o.re + o.im * o.im) AS amplitude, atan2(f.im, f.re) AS phase
  FROM f JOIN n ON n.vec_id = f.vec_id JOIN f o ON o.vec_id = n.donor AND o.c = f.c AND o.u = f.u AND o.w = f.w, {_values(pairs.STRENGTH["mix"])}),
 r AS (SELECT vec_id, severity, c, y, x, sum(amplitude * cos(phase + a)) / 64 AS v FROM m JOIN g USING (u, w) GROUP BY 1, 2, 3, 4, 5)
 SELECT vec_id, severity, c, {_MASS.format(v="greatest(least(v, 1), 0)", side=8)} FROM r GROUP BY 1, 2, 3""")
def image_fourier(spark, d):
    return _by_channel(_changed(spark, d, "mix", pairs.STRENGTH["mix"]), "image", "vec_id", "severity")


@query(f"""WITH {_PX}, {_kernels([(8, s) for s in SIZES.values()] + [(s, 8) for s in SIZES.values() if s != 8])},
 low AS (SELECT vec_id, c, a.size_out AS inner_size, a.o AS y, b.o AS x, sum(a.w * b.w * v) AS v FROM px JOIN k a ON a.size = 8 AND a.i = y JOIN k b ON b.size = 8 AND b.size_out = a.size_out AND b.i = x GROUP BY 1, 2, 3, 4, 5),
 high AS (SELECT vec_id, c, inner_size, a.o AS y, b.o AS x, sum(a.w * b.w * v) AS v FROM low JOIN k a ON a.size = inner_size AND a.size_out = 8 AND a.i = y JOIN k b ON b.size = inner_size AND b.size_out = 8 AND b.i = x GROUP BY 1, 2, 3, 4, 5)
 SELECT vec_id, severity, c, {_MASS.format(v="greatest(least(v, 1), 0)", side=8)} FROM high JOIN {_values(SIZES)} ON strength = inner_size GROUP BY 1, 2, 3""")
def image_resolution(spark, d):
    return _by_channel(_changed(spark, d, "resolution", SIZES), "image", "vec_id", "severity")


@query(f"""WITH {_PX}, {_kernels([(8, 28)])}, r AS (SELECT vec_id, c, a.o AS y, b.o AS x, sum(a.w * b.w * v) AS v FROM px JOIN k a ON a.i = y JOIN k b ON b.i = x GROUP BY 1, 2, 3, 4),
 s AS (SELECT vec_id, c, y, x, (v - [{", ".join(map(str, images.MEAN))}][c + 1]::DOUBLE) / [{", ".join(map(str, images.DEVIATION))}][c + 1]::DOUBLE AS v FROM r)
 SELECT vec_id, c, {_MASS.format(v="v", side=28)} FROM s GROUP BY 1, 2""")
def image_preprocessed(spark, d):
    ready = tensors(spark, d).select("vec_id", images.preprocessed(F.col("image"), 28).alias("image"))
    return _by_channel(ready, "image", "vec_id", side=28)


@query(f"""WITH {_PX} SELECT vec_id, c, {_MASS.format(v="round(v * 255) / 255", side=8)} FROM px GROUP BY 1, 2""")
def image_decoded(spark, d):
    """Every image as a PNG file, its digest compared, and decoded again."""
    made = tensors(spark, d).select("vec_id", F.col("vec_id").cast("string").alias("path"), images.encoded(F.col("image")).alias("content"))
    digests = made.select("path", F.sha2("content", 256).alias("sha256"))
    return _by_channel(images.decoded(made, digests), "image", "vec_id")


_GREY = "floor((19595 * round(r * 255) + 38470 * round(g * 255) + 7471 * round(b * 255) + 32768) / 65536)"
_LOBES = "CASE WHEN t = 0 THEN 1 WHEN abs(t) < 3 THEN 3 * sin(pi() * t) * sin(pi() * t / 3) / (pi() * pi() * t * t) ELSE 0 END"


@query(f"""WITH {_PX}, grey AS (SELECT vec_id, y, x, {_GREY} AS v FROM (SELECT vec_id, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b FROM px GROUP BY 1, 2, 3)),
 k0 AS (SELECT o, i, (o + 0.5) * 8 / 9.0::DOUBLE AS centre FROM range(9) o(o), range(8) i(i)),
 k1 AS (SELECT o, i, i + 0.5 - centre AS t FROM k0 WHERE i >= greatest(floor(centre - 2.5), 0) AND i < least(floor(centre + 3.5), 8)), k2 AS (SELECT o, i, {_LOBES} AS w FROM k1),
 k3 AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) * 4194304 AS w FROM k2), k AS (SELECT o, i, trunc(w + CASE WHEN w < 0 THEN -0.5 ELSE 0.5 END)::BIGINT AS w FROM k3),
 wide AS (SELECT vec_id, y, o AS x, greatest(least(floor((sum(w * v::BIGINT) + 2097152) / 4194304.0::DOUBLE), 255), 0) AS v FROM grey JOIN k ON i = x GROUP BY 1, 2, 3),
 bits AS (SELECT a.vec_id, a.y * 8 + b.x - 1 AS place, b.v > a.v AS bit FROM wide a JOIN wide b ON b.vec_id = a.vec_id AND b.y = a.y AND b.x = a.x + 1)
 SELECT vec_id, lower(printf('%016x', sum(CASE WHEN bit THEN 1::UBIGINT << (63 - place)::INT ELSE 0 END)::UBIGINT)) AS dhash FROM bits GROUP BY 1""")
def image_hashes(spark, d):
    """Difference hash; the planes are 8 high, so only the width is resampled."""
    return tensors(spark, d).select("vec_id", F.lower(F.lpad(F.hex(images.difference_hash(F.col("image"))), 16, "0")).alias("dhash"))


@query("""SELECT vec_id, sha256('{"family":"resolution","severity":"severe","source":"' || sha256('v1' || chr(0) || vec_id) || '","version":"v1"}') AS cache_key, (128 + 4 * 192)::BIGINT AS bytes, true AS sound FROM embeddings""")
def tensor_cache(spark, d):
    """The severest resolution change of every image in a cache, filled twice and verified."""
    folder = f"{shared_dir(spark)}/tensor-cache"
    key = cache.cache_key({"source": ids.digest("v1", F.col("vec_id")), "family": F.lit("resolution"), "severity": F.lit("severe"), "version": F.lit("v1")})
    image = images.intervene(F.col("image"), F.col("image"), F.lit("resolution"), F.lit(2), F.array(F.lit(1.0)))
    wanted = tensors(spark, d).select("vec_id", key.alias("cache_key"), image.alias("tensor"))
    filled = cache.fill(wanted, folder)
    broken = cache.violations(wanted, folder).select("cache_key", F.lit(False).alias("sound"))
    met = wanted.select("vec_id", "cache_key").join(filled.select("cache_key", "bytes"), "cache_key").join(broken, "cache_key", "left")
    return met.select("vec_id", "cache_key", "bytes", F.coalesce("sound", F.lit(True)).alias("sound"))


_CELLS = "l AS (SELECT vec_id, (i // 25)::INT AS layer, (i % 25 // 5)::INT AS r, (i % 5)::INT AS c, exp(v) AS v FROM e WHERE i < 50), w AS (SELECT vec_id, layer, r, c, v / sum(v) OVER (PARTITION BY vec_id, layer, r) AS v FROM l)"


@query(f"""WITH {_PX}, {_CELLS}, a AS (SELECT vec_id, layer, r, c, (v + (r = c)::INT) / 2 AS v FROM w),
 j AS (SELECT y.vec_id, x.c, sum(y.v * x.v) AS v FROM a y JOIN a x ON x.vec_id = y.vec_id AND y.layer = 1 AND x.layer = 0 AND y.c = x.r WHERE y.r = 0 AND x.c > 0 GROUP BY 1, 2),
 g AS (SELECT vec_id, (c - 1) // 2 AS y, (c - 1) % 2 AS x, v FROM j), t AS (SELECT o, greatest(least((o + 0.5) / 2 - 0.5, 1), 0) AS at FROM range(4) o(o)),
 h AS (SELECT vec_id, b.o AS y, a.o AS x, sum(v * (CASE WHEN g.y = 1 THEN b.at ELSE 1 - b.at END) * (CASE WHEN g.x = 1 THEN a.at ELSE 1 - a.at END)) AS v FROM g, t a, t b GROUP BY 1, 2, 3),
 n AS (SELECT *, min(v) OVER (PARTITION BY vec_id) AS low, max(v) OVER (PARTITION BY vec_id) AS high FROM h)
 SELECT vec_id, round(sum((v - low) / (high - low) * ((y * 4 + x) * 7 % 13)), 6) + 0.0 AS mass FROM n GROUP BY 1""")
def attention_maps(spark, d):
    """Two layers of five tokens from each representation, rolled out and stretched to 4 x 4."""
    raw = F.transform(F.slice("embedding", 1, 50), lambda v: F.exp(v.cast("double")))
    row = lambda i: F.aggregate(F.slice("raw", F.floor(i / 5).cast("int") * 5 + 1, 5), F.lit(0.0), lambda a, v: a + v)
    rows = table(spark, d, "embeddings").select("vec_id", raw.alias("raw"))
    layers = images.from_vector(F.transform("raw", lambda v, i: v / row(i)), 2, 5, 5)
    rolled = rows.select("vec_id", layers.alias("layers")).select("vec_id", attention.rollout(F.col("layers"), 4, 4).alias("map"))
    return rolled.select("vec_id", _mass(F.col("map"), 0, 4).alias("mass"))


_METRICS = "SELECT l_suppkey, l_returnflag AS family, CASE WHEN l_linenumber <= 2 THEN 'mild' ELSE 'severe' END AS severity, count(*) AS n, round(avg(l_extendedprice), 2) AS mean_price, count(*) FILTER (WHERE l_discount < 0.05) AS low, count(*) FILTER (WHERE l_discount >= 0.05) AS high FROM lineitem GROUP BY ALL"


@query(f"""SELECT l_suppkey, family, severity, '[' || low || ',' || high || ']' AS bins, mean_price, n FROM ({_METRICS})""")
def nested_metrics(spark, d):
    """Metrics of conditions as one nested document a supplier, and flattened to a wide table again."""
    severity = F.when(F.col("l_linenumber") <= 2, "mild").otherwise("severe")
    low = F.col("l_discount") < 0.05
    each = table(spark, d, "lineitem").groupBy("l_suppkey", F.concat_ws(":", "l_returnflag", severity).alias("condition")).agg(
        F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 2).alias("mean_price"), F.array(F.count_if(low), F.count_if(~low)).alias("bins"),
    )
    entry = F.struct(F.col("condition").alias("key"), F.struct("n", "mean_price", "bins").alias("value"))
    documents = each.groupBy("l_suppkey").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("conditions"))).alias("document"))  # six conditions each
    return nested.wide(nested.entries(documents, "document", "conditions", "l_suppkey"), "l_suppkey")
