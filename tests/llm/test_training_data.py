"""The training-data operators against brute force, with odd rows: null, empty, repeated, long, tied, and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bpe, imatch, langid, licenses, linededup, packing, pii, quality, simhash, substrings

WHITE = " \t\n\x0b\x0c\r"
EDGE = [
    (-1, None), (-2, ""), (-3, "AÉ b\r\n" * 3), (-4, "x" * 50 + "\n" + " é" * 30000), (-5, "don't <|endoftext|> it's\n\n  日本 ①"),
    (-6, "mail a.b@c.de, x@y 1.2.3.4 999.1.1.1 é 4845168114407329! +1 (017) 555-7713 and+49 30 123456789."), (-7, "token = \"cb1a9fee807a05366fcb8b6c95c7c565ede51a72\" 🎉 a@b-c.d.e.."),
]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(i, t, None, None, 0) for i, t in EDGE], base.schema)
    extra = [F.lit("clash").alias(c) for c in ("h1", "fp", "n_lines", "component", "key", "bucket", "m", "removed", "base")]
    return base.unionByName(odd).select("*", *extra).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s)


def test_packing(docs, texts, tokenizer):
    rows = packing.pack(docs).collect()
    by, used = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    for d, text in texts.items():
        ids, at = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for k, spans in used.items():
        ends = [0, *(o + n for o, n in sorted(spans))]
        assert [o for o, _ in sorted(spans)] == ends[:-1]
        assert ends[-1] == 2048 or k == max(used)


def test_hilbert_curve_visits_neighbours(spark):
    cells = spark.range(512).select(*[F.shiftright("id", 3 * i).bitwiseAND(7).alias(f"x{i}") for i in range(3)])
    rows = sorted(cells.select(packing.hilbert_key(F.struct("x0", "x1", "x2"), 3).alias("key"), "*").collect())
    assert [r.key for r in rows] == list(range(512))
    path = np.array([r[1:] for r in rows])
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packing_follows_the_curve(docs):
    """Brute force of the order: sort by key, lay end to end."""
    rows = packing.pack(docs.where("text is not null"), keep_ids=True).orderBy("sequence_id", "offset").collect()
    at = [r.sequence_id * 2048 + r.offset for r in rows]
    assert at == [sum(r.length for r in rows[:k]) for k in range(len(rows))]
    table = packing.tokens(docs.where("text is not null")).collect()
    p = np.array([[r.p0, r.p1, r.p2] for r in table])
    cells = np.clip(np.floor(((p - p.mean(0)) / p.std(0) + 2.5) / 5 * 128), 0, 127)
    where = {r.doc_id: c for r, c in zip(table, cells)}
    order = list(dict.fromkeys(r.doc_id for r in rows))
    step = lambda ids: np.mean([np.abs(where[a] - where[b]).sum() for a, b in zip(ids, ids[1:])])
    assert len(order) == len(where) and step(order) < step(sorted(order)) / 2


def test_bucket_of_is_bisection(spark):
    from lodestone.llm.native import bucket_of

    for bounds in ([], [5], [1, 2, 3], [-7, 0, 4, 9, 10, 11, 12, 99]):
        got = spark.range(-10, 120).select("id", bucket_of(F.col("id"), bounds).alias("b")).collect()
        assert all(r.b == sum(x < r.id for x in bounds) for r in got)


def test_line_dedup(docs, texts):
    key = lambda line: lower(line.strip(WHITE))
    held = collections.defaultdict(set)
    for d, x in texts.items():
        for line in x.split("\n"):
            held[key(line)].add(d)
    gone = lambda d, k: len(k) >= 40 and len(held[k]) >= 3 and max(held[k]) != d
    for r in linededup.dedup_lines(docs, min_docs=3).collect():
        lines = texts[r.doc_id].split("\n")
        kept = [x for x in lines if not gone(r.doc_id, key(x))]
        assert (r.n_lines, r.n_dropped, r.text) == (len(lines), len(lines) - len(kept), "\n".join(kept))


def test_hot_line(spark):
    hot = "the same very long line of text, over and over again in all of them"
    rows = [(i, f"{hot}\nline of its own number {i} that is long enough to count too\n{hot.upper()}") for i in range(3000)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_dropped for r in got) == 2 * 2999 and next(r for r in got if r.doc_id == 2999).n_dropped == 0


def test_line_repeated_within_documents_counts_them_once(spark):
    line = "a line of more than forty code points, repeated within a document"
    rows = [(i, "\n".join([line] * 9)) for i in range(4)]
    assert all(r.n_dropped == 0 for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_simhash(docs, texts):
    prints = {}
    for d, x in texts.items():
        w = words(lower(x))
        parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    root = {d: d for d in prints}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for r in simhash.near_duplicates(docs).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", find(r.doc_id))
    kept = [r.doc_id for r in simhash.drop_near_duplicates(docs.unionByName(docs)).collect()]
    assert sorted(kept) == sorted(d for d in prints if find(d) == d)


def test_chains_of_fingerprints_are_one_component(spark):
    prints = spark.createDataFrame([(sum(3 << (2 * j) for j in range(i)),) for i in range(20)] + [(1 << 62,)], "fp long")
    from lodestone.operators.components import connected_components

    assert {r.component for r in connected_components(simhash.links(prints)).collect()} == {0}


def test_multi_index_links_against_brute_force(spark):
    """Random fingerprints around centres, every radius and number of segments, with and without hot values."""
    from lodestone.operators.components import connected_components

    rng = np.random.default_rng(6)
    prints = {int(c) for c in rng.integers(-(1 << 63), 1 << 63, 6)}
    for c in list(prints):
        for _ in range(15):
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                c ^= -(1 << 63) if b == 63 else 1 << int(b)
                prints.add(c)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long").coalesce(1).cache()
    for radius, segments, hot in ((2, 2, 64), (2, 2, 1), (2, 1, 64), (4, 4, 2)):
        root = {p: p for p in prints}

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a in prints:
            for b in prints:
                if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius and (x := find(a)) != (y := find(b)):
                    root[max(x, y)] = min(x, y)
        got = {r.node: r.component for r in connected_components(simhash.links(frame, radius, segments, hot)).collect()}
        assert got == {p: find(p) for p in prints if find(p) != p or any(find(q) == p for q in prints if q != p)}


def test_rows_that_share_a_doc_id(spark):
    """A row goes if its own text is not the one kept, whatever other rows have its doc_id; columns of any name stay."""
    from lodestone.llm import nearcopies

    rows = [(1, "a b c d e f", "x"), (1, "g h i j k l", "y"), (2, "a b c d e f", "z"), (0, "g h i j k l", "w"), (0, "g h i j k l", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _keep string").withColumn("th", F.lit(1)).withColumn("again", F.lit(2))
    for drop in (simhash.drop_near_duplicates, nearcopies.drop_near_copies):
        assert sorted(tuple(r) for r in drop(docs).collect()) == [(0, "g h i j k l", "w", 1, 2), (1, "a b c d e f", "x", 1, 2)]


def test_quality(docs, texts):
    for r in quality.score(docs).collect():
        x, w = texts[r.doc_id], words(texts[r.doc_id])
        count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [line for line in x.split("\n") if words(line)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_imatch(docs, texts):
    ids = sorted(texts, reverse=True)
    rows = imatch.fingerprint_edits(docs).collect()
    prints = {}
    for r in rows:
        x, y = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        m = len(x) // 3
        edited = x[: len(x) - m] + y[:m]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(x, r.fingerprint) == r.fingerprint
    assert len(rows) == len(texts) and np.mean([r.near_edited for r in rows]) > 5 * np.mean([r.near_next for r in rows])


def test_hash_table_answers_exactly():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(1 << 63), 1 << 63, 5000).tolist()
    table = imatch.hash_table(keys)
    size = len(table)
    held = lambda h: table[h & (size - 1)] == h or table[h >> 32 & (size - 1)] == h
    assert all(map(held, keys)) and not any(held(h) for h in [*range(3000), *rng.integers(-(1 << 63), 1 << 63, 3000).tolist()] if h not in set(keys))


def test_bpe(docs, texts, tokenizer):
    for r in bpe.encode_decode(docs).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_cuts_long_texts_between_pieces(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    for text in ("ab  c\x1c d\u00a0 e's\n\n f" * 40, "no break at all " * 60, "x" * 300, "a \n b" * 100):
        (ids,) = bpe.encoder().encode([text])
        assert tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_bpe_on_random_text(tokenizer):
    import random

    rng, coder = random.Random(3), bpe.encoder()
    odd = ["".join(rng.choice("ab'stvremdl \n\t  1!é日 \x1c") for _ in range(rng.randrange(60))) for _ in range(1500)]
    for text, ids in zip(odd, coder.encode(odd)):
        assert tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist()
        assert coder.decode(ids) == text


def test_substring_dedup(docs, texts):
    first, gone = set(), collections.defaultdict(set)
    for d in sorted(texts):
        parts = substrings.sentences(texts[d])
        assert "".join(parts) == texts[d]
        for i, j, *_ in sorted(substrings.spans(texts[d])):
            key = " ".join(" ".join(parts[i:j]).lower().split())
            if key in first:
                gone[d] |= set(range(i, j))
            first.add(key)
    for r in substrings.dedup_spans(docs).collect():
        parts = substrings.sentences(texts[r.doc_id])
        assert (r.n_removed, r.text) == (len(gone[r.doc_id]), "".join(s for k, s in enumerate(parts) if k not in gone[r.doc_id]))


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_repeated_spans_over_partitions(spark, parts):
    """A hash whose places fill many partitions, repeated rows and a null doc_id."""
    rows = [(d, d or 7, -1, i, i + 1, 5 if d is None or d % 3 else 6 + d % 2, i % 2) for d in [*range(400), 3, 3, None] for i in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, th long, tl int, i int, j int, h long, g int")
    place = lambda r: (r[0] is None, r[0] or 0, *r[1:4])
    first = {}
    for r in rows:
        first[r[5:]] = min(first.get(r[5:], place(r)), place(r))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {tuple(r) for r in substrings.repeated_spans(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {r[:5] for r in rows if place(r) != first[r[5:]]}


def test_language_id(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in rows.collect()}
    odd = spark.createDataFrame([(-1, None, "en", None, 0), (-2, "12 !", "en", None, 0)], rows.schema)
    got = langid.identify(rows.unionByName(odd)).collect()
    held = [r for r in got if r.held_out and r.doc_id >= 0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert {(r.lang_pred, r.score) for r in got if r.doc_id < 0} == {("und", 0.0)}
    assert {r.lang_pred for r in langid.identify(rows.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


#: The contract's patterns as they stand there.
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(s):
    d = [int(c) for c in re.sub("[^0-9]", "", s)]
    return 12 <= len(d) <= 19 and sum(v * (1 + i % 2) - 9 * (v * (1 + i % 2) > 9) for i, v in enumerate(reversed(d))) % 10 == 0


def test_pii(docs, texts):
    checks = [(PLAIN[0], lambda s: True), (PLAIN[1], lambda s: all(int(p) <= 255 for p in s.split("."))), (PLAIN[2], luhn), (PLAIN[3], lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15)]
    model = pii.train(docs)
    for r in pii.find(docs, model).collect():
        base = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(checks) for m in re.finditer(p, texts[r.doc_id]) if ok(m.group()))
        told = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest() and set(told) <= set(r.spans.split(",")) | {""}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[-1] is None and clean[-6].startswith("mail [email], x@y [ip] 999.1.1.1 é [card]! [phone] and[phone].")


def test_base_patterns_match_as_the_plain_ones(spark):
    """Random and very long texts; the plain patterns by Python's re."""
    import random

    rng = random.Random(8)
    texts = ["".join(rng.choice("a_.@.-+ 12() é\n") for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["1 " * 20_000, "a@b" + ".c" * 20_000, "1" * 2_000, "1." * 2_000, "a.b@c " * 500, "+1" * 500, "x" * 2_000, "a@b.c_d@e.f" * 200, "@" * 2_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    searches = [(p, True, F.lit(True)) for p in (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE)]
    for r in rows.select("i", pii.found(F.col("text"), searches).alias("f")).toLocalIterator():
        for k, plain in enumerate(PLAIN):
            assert [(x.s, x.e) for x in r.f[k]] == [m.span() for m in re.finditer(plain, texts[r.i])], (texts[r.i][:80], k)


def test_long_texts_of_numbers(spark):
    """Many candidates in one line: found, redacted, and no deep recursion."""
    digits = pii.FEATURES.index("digits")
    rows = spark.createDataFrame([(0, "1 " * 20_000), (1, "1-" * 10_000), (2, "a@b" + ".c" * 20_000 + " 1.2.3.4" * 2_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(rows, ([(digits, 18.5, -1.0, 1.0)], 0.5)).collect()}
    ends = [tuple(map(int, x.split(":")[1:])) for x in got[0].spans.split(",")]  # runs of 19 digits end to end
    assert len(ends) > 500 and all(b[0] >= a[1] for a, b in zip(ends, ends[1:]))
    assert got[1].spans == "secret:0:20000" or got[1].spans == "number:0:20000"  # one token
    assert (got[2].n_email, got[2].n_ip) == (1, 2_000)


def test_resolve_against_brute_force(spark):
    """The rule of resolve, in plain Python."""
    import random

    rng, rows = random.Random(2), []
    for i in range(300):
        items = []
        for _ in range(rng.randrange(40) if i else 1500):
            s = rng.randrange(60 if i else 9000)
            items.append((s, rng.randrange(5) > 0, s + rng.randrange(1, 9), rng.randrange(8), float(rng.randrange(4))))
        rows.append((i, sorted((s, int(f), e, k, o if f else None) for s, f, e, k, o in items)))
    frame = spark.createDataFrame(rows, "i int, items array<struct<s:bigint,f:int,e:bigint,k:int,o:double>>")
    got = {r.i: [tuple(x) for x in r.out] for r in frame.select("i", pii.resolve(F.col("items")).alias("out")).collect()}
    for i, items in rows:
        held = out = None
        wall, want = 0, []
        for x in items:
            s, f, e, k, o = x
            clear, back = held is None or held[2] <= s, out is not None and out[2] <= s
            if not f:
                want += [held] if clear else [out] if back else []
                held, out, wall = None, None, max(wall, e)
            elif s < wall:
                continue
            elif clear:
                want.append(held)
                held, out = x, None
            elif o > held[4] or o == held[4] and e - s > held[2] - held[0]:
                if back:
                    want.append(out)
                held, out = x, None if back else held
        want = [(x[0], x[2], x[3]) for x in [*want, held] if x]
        assert got[i] == want


def test_licenses(spark):
    said = {1: "Released under the MIT License.", 2: "A driving licence is required.", 3: None, 4: "x\nLicensed under CC BY-NC 4.0.", 5: "Licensed under the Apache License, Version 2.0."}
    rows = spark.createDataFrame(list(said.items()), "doc_id long, text string")
    got = {r.doc_id: r.families for r in licenses.scan(rows).collect()}
    assert got == {1: ["mit"], 2: [], 3: [], 4: ["cc-by-nc"], 5: ["apache"]}


@pytest.mark.parametrize("f", [packing.pack, linededup.dedup_lines, licenses.scan, simhash.near_duplicates, quality.score, imatch.fingerprint_edits, bpe.encode_decode, substrings.dedup_spans, langid.identify, pii.find, pii.redact, langid.keep_identified])
def test_empty_table(docs, f):
    assert f(docs.limit(0)).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, "").cache()
        assert after.columns == docs.columns, name
        now = after
    assert {-1, -2}.isdisjoint({r.doc_id for r in now.collect()})
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() > 0
