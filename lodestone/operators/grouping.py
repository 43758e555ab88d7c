"""Exact and near-duplicate groups, and a split that keeps groups whole."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lodestone.operators.components import connected_components
from lodestone.operators.ordering import before
from lodestone.storage import materialize


def duplicate_counts(rows: DataFrame, content: str) -> DataFrame:
    """n, distinct_contents, surplus of a table by content hash."""
    return rows.agg(F.count("*").alias("n"), F.count_distinct(content).alias("distinct_contents"), (F.count("*") - F.count_distinct(content)).alias("surplus"))


def simhash_bits(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """by, bits: the 64-bit number whose bits are set in over half of the group's values (nulls left out; 0 without values).

    Sums of the 64 bits are aggregated before the shuffle, so it carries a row for each group.
    """
    sums = rows.groupBy(*by).agg(F.count(value).alias("_n"), *[F.sum(F.getbit(F.col(value), F.lit(k)).cast("long")).alias(f"_{k}") for k in range(64)])
    bit = [F.when(2 * F.col(f"_{k}") > F.col("_n"), F.lit((1 << k) - (1 << 64 if k == 63 else 0))).otherwise(F.lit(0)).cast("long") for k in range(64)]
    return sums.select(*by, reduce(lambda x, y: x.bitwiseOR(y), bit).alias("bits"))


def word_bits(text: str | None) -> int:
    """The 64-bit number whose bits are set in over half of the words' SHA-256 (first 8 bytes; A-Z lower-cased, split at blanks; 0 without words)."""
    found = Counter(w for w in (text or "").encode().lower().split(b" ") if w)
    digests = b"".join(hashlib.sha256(w).digest()[:8] for w in found)
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    sums = np.fromiter(found.values(), np.int64, len(found)) @ bits.astype(np.int64)
    return int.from_bytes(np.packbits(2 * sums > found.total()).tobytes(), "big", signed=True)


ENTRIES = 200_000  # entries of a partition of the bands' table
BLOCK = 1 << 14  # members of a part that are compared in one task; larger parts are dealt in blocks, each pair of blocks by itself
SMALL = 64  # members of a part up to which all parts of a batch are compared together
CELLS = 1 << 16  # pairs of a larger part that are compared at once


def near_places(h: np.ndarray, starts: np.ndarray, block: np.ndarray, crossed: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """i, j: places of numbers h at most radius bits apart in one group (a group begins at each of starts); in crossed groups, whose rows stand by block, those of different blocks."""
    ends = np.append(starts[1:], len(h))
    sizes = ends - starts
    left = np.where(np.repeat(sizes <= SMALL, sizes), np.repeat(ends, sizes) - 1 - np.arange(len(h)), 0)
    at, step = np.flatnonzero(left), 1
    while len(at):
        i = at[np.bitwise_count(h[at] ^ h[at + step]) <= radius]
        i = i[~crossed[i] | (block[i] != block[i + step])]
        yield i, i + step
        step += 1
        at = at[left[at] >= step]
    for s, e in zip(starts[sizes > SMALL].tolist(), ends[sizes > SMALL].tolist()):
        cut = s + int(np.searchsorted(block[s:e], block[s], "right")) if crossed[s] else e
        rows = max(1, CELLS // (e - s))
        for i in range(s, cut, rows):
            upto = min(i + rows, cut)
            first = cut if crossed[s] else i
            x, y = np.nonzero(np.bitwise_count(h[i:upto, None] ^ h[None, first:e]) <= radius)
            x, y = x + i, y + first
            yield (x, y) if crossed[s] else (x[x < y], y[x < y])


def join_places(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (the least place of each place's component) after i and j are joined."""
    found: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := found.get(x, x)) != x:
            found[x] = x = found.get(y, y)
        return x

    for x, y in zip(root[i].tolist(), root[j].tolist()):
        x, y = top(x), top(y)
        if x != y:
            found[max(x, y)] = min(x, y)
    if found:
        moved = np.arange(len(root))
        moved[list(found)] = [top(x) for x in found]
        root = moved[root]
    return root


def _close(classes: DataFrame, radius: int, spare: int, forest: bool) -> DataFrame:
    """a < b, distance: the pairs of classes (h, id) at most radius bits apart, each once; with forest, links that give the same components (distance of the two ends).

    The numbers are cut into radius + spare bands of bits: those within the radius
    agree in some set of spare bands, so they meet in a part (a set and its bits);
    a pair counts where it meets first. Parts are compared in Arrow batches. One of more than BLOCK members is
    dealt in blocks by a hash, and each two blocks meet by themselves, so
    no task holds or compares more than two blocks at once. A forest ties
    each member of a part to the least that it is connected with there, so links
    grow with the members and not with their pairs.
    """
    cuts = [64 * b // (radius + spare) for b in range(radius + spare + 1)]
    bands = [(1 << high) - (1 << low) for low, high in zip(cuts, cuts[1:])]
    sets = [sum(c) for c in combinations(bands, spare)]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in sets])
    keyed = classes.select("id", "h", F.posexplode(F.transform(masks, lambda m: F.col("h").bitwiseAND(m))).alias("set", "part"))
    large = keyed.groupBy("set", "part").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = materialize(large.select("set", "part", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large")
    more = large.agg(F.sum(F.col("n") * (F.col("blocks") - 1))).first()[0] or 0
    parts = -(-(classes.count() * comb(radius + spare, spare) + more) // ENTRIES)
    dealt = keyed.join(F.broadcast(large), ["set", "part"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # at most a row for each BLOCK entries
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("h"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("set", "part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "h", "id")
    dealt = dealt.repartition(max(parts, 1), "set", "part", "low", "high").sortWithinPartitions("set", "part", "low", "high", "block", "id")
    kind = classes.schema["id"].dataType
    schema = StructType([StructField("a", kind), StructField("b", kind), StructField("distance", IntegerType())])
    each = np.array(sets, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ENTRIES // 4:
                table = pa.Table.from_batches(held).combine_chunks()
                starts = group_starts(table)
                yield from compared(table.slice(0, starts[-1]), starts[:-1])
                held = table.slice(starts[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from compared(table, group_starts(table))

    def group_starts(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(table.num_rows - 1, 0), bool)
        for c in ("set", "part", "low", "high"):
            v = table[c].to_numpy()
            change |= v[1:] != v[:-1]
        return np.append(0, np.flatnonzero(change) + 1)

    def compared(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        at, h, block = table["set"].to_numpy(), table["h"].to_numpy().view(np.uint64), table["block"].to_numpy()
        ids, root = table["id"].combine_chunks(), np.arange(len(h))
        found, n = [], 0
        for i, j in near_places(h, starts, block, table["low"].to_numpy() != table["high"].to_numpy(), radius):
            if forest:
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
            first = np.argmax(((h[i] ^ h[j])[:, None] & each) == 0, axis=1) == at[i]
            i, j = i[first], j[first]
            if forest and len(i):
                root = join_places(root, i, j)
            elif len(i):
                found.append((i, j))
                n += len(i)
            if n >= ENTRIES:
                yield told(ids, h, *map(np.concatenate, zip(*found)))
                found, n = [], 0
        if forest:
            j = np.flatnonzero(root != np.arange(len(h)))
            yield told(ids, h, root[j], j)
        elif found:
            yield told(ids, h, *map(np.concatenate, zip(*found)))

    def told(ids: pa.Array, h: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(np.bitwise_count(h[i] ^ h[j]).astype(np.int32))], ["a", "b", "distance"])

    return dealt.mapInArrow(run, schema).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").where("a < b")


def hamming_edges(rows: DataFrame, key: str, bits: str, radius: int = 4, spare: int = 2, forest: bool = False) -> DataFrame:
    """a < b, distance: pairs of class representatives at most radius bits apart, and membership at distance 0.

    A class is the rows of one number; its smallest key represents it and is tied
    to each other member, so copies cost a row each and never their square. The
    representatives meet in parts that share some bands of bits (`_close`), and each
    pair is kept once. The table of entries has a partition for ENTRIES of them, whatever
    its compressed size, so a task's sort does not grow with the rows. With forest,
    links that give the same components stand for the pairs, whose number grows
    faster than the rows.
    """
    classes = materialize(rows.groupBy(F.col(bits).alias("h")).agg(F.min(key).alias("id")).dropna(), "classes")
    near = _close(classes, radius, spare, forest)
    members = rows.select(F.col(bits).alias("h"), F.col(key).alias("b")).join(classes, "h").where("id <> b")
    return near.unionByName(members.select(F.col("id").alias("a"), "b", F.lit(0).alias("distance")))


def content_ids(members: DataFrame, group: str, content: str) -> DataFrame:
    """group, group_id (SHA-256 of the group's sorted contents, joined by line breaks; nulls left out).

    Contents are sorted by Spark, which spills, and hashed as they come, so a group of any size is never held.
    """
    schema = StructType([members.schema[group], StructField("group_id", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, empty = None, None, True
        for batch in batches:
            groups, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names, ids, start = [], [], 0
            while start < len(groups):
                if state is None or groups[start] != now:
                    if state is not None:
                        names.append(now)
                        ids.append(state.hexdigest())
                    now, state, empty = groups[start], hashlib.sha256(), True
                end = start + 1
                while end < len(groups) and groups[end] == now:
                    end += 1
                if text := [c for c in contents[start:end] if c is not None]:
                    state.update(("" if empty else "\n").encode() + "\n".join(text).encode())
                    empty = False
                start = end
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field(0).type), pa.array(ids, pa.string())], [group, "group_id"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field(0).type), pa.array([state.hexdigest()])], [group, "group_id"])

    return members.select(group, content).dropna(subset=[group]).repartition(group).sortWithinPartitions(group, content).mapInArrow(run, schema)


def duplicate_groups(rows: DataFrame, key: str, content: str, edges: DataFrame) -> DataFrame:
    """key, group_key (smallest key of the group), group_id (hash of the members' sorted contents; a group's digests, 65 bytes a member, pass through one task).

    Groups join equal contents and the edges a, b.
    """
    same = rows.withColumn("a", F.min(key).over(Window.partitionBy(content))).select("a", F.col(key).alias("b")).where("a <> b")
    parts = connected_components(same.unionByName(edges.select("a", "b")), "a", "b")
    labelled = rows.join(parts, rows[key] == parts["node"], "left").select(key, content, F.coalesce("component", key).alias("group_key"))
    return labelled.join(content_ids(labelled, "group_key", content), "group_key").select(key, "group_key", "group_id")


LARGE = 0.01  # share of its stratum beyond which a group is dealt by itself


def grouped_split(rows: DataFrame, group: str, label: str, fractions: dict[str, float], seed: int = 7) -> DataFrame:
    """rows with role: groups stay whole, and every label comes near its fractions.

    A group belongs to the stratum of its most frequent label (ties: the first). Groups of more
    than LARGE of a stratum, 1 / LARGE of them at most, go largest first to the role
    that misses most. The others stand in the order of a hash, and what each role
    still misses is a stretch of that line; so a role misses its share of a stratum by no more
    than LARGE of it at either end of its stretch, and what large groups exceed (labels
    that share groups with the label of a large one are displaced with it). No group and no
    count of groups reaches the driver, and a stratum's line goes over many tasks.
    """
    name = F.coalesce(F.col(label).cast("string"), F.lit("(none)"))
    each = rows.groupBy(F.col(group).alias("_group"), name.alias("_stratum")).agg(F.count("*").alias("_n"))
    first = F.min(F.struct(-F.col("_n"), "_stratum"))  # the most frequent label, then the first by name
    placed = each.groupBy("_group").agg(F.sum("_n").alias("_size"), first.alias("_m")).select("_group", F.col("_m._stratum").alias("_stratum"), "_size")
    placed = materialize(placed, "split")
    total = placed.groupBy("_stratum").agg(F.sum("_size").alias("_total"))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_group").cast("string"), F.lit("(none)"))), 256)
    sized = placed.join(total, "_stratum").withColumn("_hash", digest)
    big = F.col("_size") > LARGE * F.col("_total")
    roles = list(fractions)

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        left = {r: fractions[r] * part["_total"].iloc[0] for r in roles}
        given = []
        for size in (ordered := part.sort_values(["_size", "_hash"], ascending=[False, True]))["_size"]:
            role = max(roles, key=lambda r: left[r])
            left[role] -= size
            given.append(role)
        return pd.DataFrame({"_stratum": ordered["_stratum"], "_hash": ordered["_hash"], "role": given})

    dealt = materialize(sized.where(big).select("_stratum", "_hash", "_size", "_total").groupBy("_stratum").applyInPandas(deal, "_stratum string, _hash string, role string"), "large")
    large = sized.where(big).join(dealt, ["_stratum", "_hash"])
    taken = large.groupBy("_stratum").agg(*[F.coalesce(F.sum(F.when(F.col("role") == r, F.col("_size"))), F.lit(0)).alias(f"_{k}") for k, r in enumerate(roles)])
    rest = [F.greatest(F.lit(fractions[r]) * F.col("_total") - F.coalesce(f"_{k}", F.lit(0)), F.lit(0.0)) for k, r in enumerate(roles)]
    line = before(sized.where(~big), F.sum, F.col("_size"), "_hash", out="_at", by=("_stratum",)).join(taken, "_stratum", "left")
    small = sized.where(~big).groupBy("_stratum").agg(F.sum("_size").alias("_small"))
    share = (F.coalesce("_at", F.lit(0)) + F.col("_size") / 2.0) / F.col("_small") * reduce(lambda a, b: a + b, rest)
    role, upto = F.lit(roles[-1]), []
    for k in range(len(roles) - 1):
        upto.append((reduce(lambda a, b: a + b, rest[: k + 1]), roles[k]))
    for bound, r in reversed(upto):
        role = F.when(share < bound, F.lit(r)).otherwise(role)
    given = line.join(small, "_stratum").select("_group", role.alias("role")).unionByName(large.select("_group", "role"))
    return rows.alias("l").join(given.alias("r"), F.col(f"l.`{group}`").eqNullSafe(F.col("r._group"))).select("l.*", "r.role")


def split_violations(rows: DataFrame, group: str, role: str = "role") -> DataFrame:
    """group, roles of the groups that more than one role holds: a sound split gives none."""
    return rows.groupBy(group).agg(F.count_distinct(role).alias("roles")).where("roles > 1")
