"""Byte-level BPE with exact ids by per-prefix dynamic programming (operator 7).

For every prefix of a piece of text there is one last token that the merge
procedure can leave there. `Encoder.piece` finds it from left to right: an
automaton over the vocabulary lists the tokens that end at a byte, and a token
is the right one if the last token of what stands before it is compatible with
it, i.e. no merge across their border would have come first. Back-pointers
then give the ids. The work is linear in the text for a bounded token length.

Text is cut into pieces (the pre-tokenizer's split pattern) with array
operations on code points, equal pieces of a block are found by hash and
compared in full, and each distinct piece is encoded once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, LETTER, NUMBER, OTHER, END = range(5)
#: Code points of Unicode's White_Space (fixed values).
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 250_000  # code points handled at once; a longer text is cut between pieces
MEMO = 150_000  # pieces, and pairs, that a worker remembers before it starts afresh
#: A single space between two visible characters, or a line break after one, begins a piece whatever stands around.
BORDER = re.compile(r"(?<=\S)(?: (?=\S)|\n)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def largest_id(path: str | None = None) -> int:
    """The largest id that a vocabulary file gives."""
    with open(path or default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    return max(*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]))


def _classes() -> np.ndarray:
    kind = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        if first == "L":
            kind[c] = LETTER
        elif first == "N":
            kind[c] = NUMBER
    kind[WHITE] = SPACE
    return kind


def byte_letters() -> dict[str, int]:
    """Letter that stands for a byte in the vocabulary file: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids of texts as the vocabulary file defines them, without special handling but for the file's added tokens.

    by_library: leave the ids of a piece to a compiled library instead of the
    dynamic programme; for operators that need ids and are not about the encoding.
    """

    def __init__(self, path: str, by_library: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: raw(t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.token_of = {b: i for i, b in self.bytes_of.items() if i not in self.special.values()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.kind = _classes()
        self.salt = np.random.default_rng(20).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
        self._clear()
        made = [vocab[a + b] for a, b in merges]
        if by_library and sorted(made) == made:
            import tiktoken

            self.piece = tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=self.token_of, special_tokens={})._core_bpe.encode_single_piece
            del self.token_of, self.bytes_of  # the library has its own
            return
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair: (rank, token made)
        made_by: dict[int, tuple[int, int, int]] = {}  # token: (rank, left, right)
        for rank, ((a, b), token) in enumerate(zip(merges, made)):
            pair = vocab[a], vocab[b]
            self.merge.setdefault(pair, (rank, token))
            made_by.setdefault(token, (rank, *pair))
        # A token's outer parts on one side, from the whole inwards, each with the rank at which it is merged away.
        self.right, self.left = {}, {}
        for token in self.bytes_of:
            for side, to in ((2, self.right), (1, self.left)):
                parts, now, until = [], token, len(merges)
                while True:
                    parts.append((now, until))
                    if now not in made_by:
                        break
                    until, now = made_by[now][0], made_by[now][side]
                to[token] = parts
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for b, i in self.token_of.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merge procedure leaves a, b standing side by side: no parts at their border merge while both exist."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            known = True
            for x, x_until in self.right[a]:
                for y, y_until in self.left[b]:
                    found = self.merge.get((x, y))
                    # At equal rank the pair further left merges first: before b's own merge, after a's.
                    if found and found[0] < x_until and found[0] <= y_until:
                        known = False
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            self.pairs[a << 32 | b] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """ids of one piece: the last token of every prefix, then back along the pointers."""
        last = [-1] * (len(data) + 1)
        pairs = self.pairs
        # The automaton gives matches by their end, the longest first.
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            if end == length:
                last[end] = token
            elif (before := last[end - length]) >= 0:
                fits = pairs.get(before << 32 | token)
                if fits if fits is not None else self.compatible(before, token):
                    last[end] = token
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= self.size_of[last[at]]
        return ids[::-1]

    def _number(self, text: str) -> int:
        """Place of a piece in the table of encoded pieces."""
        at = self.pieces.get(text)
        if at is None:
            at = self._add(text, self.piece(text.encode("utf-8", "replace")))
        return at

    def _add(self, name: str, ids: list[int]) -> int:
        self.pieces[name] = at = len(self.begin)
        self.begin.append(len(self.flat))
        self.flat.extend(ids)
        return at

    def _clear(self) -> None:
        self.pieces: dict[str, int] = {}
        self.begin, self.flat = array("q"), array("I")
        self.decimal: list[str] = []
        self.data: list[bytes] = []

    def _starts(self, cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Start of every piece and of every END, by the split pattern of the vocabulary."""
        kind = self.kind[cp]
        kind[ends] = END
        start = np.empty(len(cp), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[ends] = True
        start[ends[:-1] + 1] = True
        # The last white space before a word: a space joins the word, another one stands alone.
        after = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END)) + 1
        start[after - 1] = True
        start[after[cp[after - 1] == 32]] = False
        # Contractions where an apostrophe begins a piece.
        quote = np.flatnonzero((cp == 39) & start)
        quote = quote[quote + 2 < len(cp)]
        one, two = cp[quote + 1], cp[quote + 2]
        for letters in ("s", "t", "re", "ve", "m", "ll", "d"):
            hit = one == ord(letters[0])
            if len(letters) == 2:
                hit &= two == ord(letters[1])
            at = quote[hit]
            start[at + 1] = False
            start[at + 1 + len(letters)] = True
        return np.flatnonzero(start)

    def distinct(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pieces of the texts, the index of every piece into them, and each text's first piece (one more at the end)."""
        whole = "\n".join(texts) + "\n"
        cp = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        start = self._starts(cp, ends)
        length = np.diff(start, append=len(cp))
        own = ~np.isin(start, ends, assume_unique=True)
        offset = np.arange(len(cp)) - np.repeat(start, length)
        while len(self.salt) < length.max(initial=1):
            self.salt = np.concatenate([self.salt, self.salt * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2)])
        mixed = (cp.astype(np.uint64) + np.uint64(1)) * self.salt[offset]
        mixed ^= mixed >> np.uint64(29)
        key = np.add.reduceat(mixed, start)
        codes, _ = pd.factorize(key)
        first = np.empty(codes.max(initial=-1) + 1, np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        like = first[codes]
        if (length != length[like]).any() or (cp != cp[np.repeat(start[like], length) + offset]).any():
            names, seen = [whole[a : a + n] for a, n in zip(start, length)], {}  # two pieces of one hash
            codes = np.array([seen.setdefault(x, len(seen)) for x in names])
            pieces = list(seen)
        else:
            pieces = [whole[a : a + n] for a, n in zip(start[first].tolist(), length[first].tolist())]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(ends, start[own]), minlength=len(texts)))])
        return pieces, codes[own], bounds

    def _segments(self, text: str) -> list[str | int]:
        """The text around added tokens, each part cut between pieces if it is long (not within a run without white space)."""
        parts: list[str | int] = [text]
        for name, token in self.special.items():
            parts = [y for x in parts for y in (self._around(x, name, token) if isinstance(x, str) and name in x else [x])]
        out: list[str | int] = []
        for x in parts:
            while isinstance(x, str) and len(x) > BLOCK:
                border = BORDER.search(x, BLOCK)
                if not border:
                    break
                out.append(x[: border.start()])
                x = x[border.start() :]
            out.append(x)
        return out

    @staticmethod
    def _around(text: str, name: str, token: int) -> list[str | int]:
        out: list[str | int] = []
        for i, x in enumerate(text.split(name)):
            out += [token] * (i > 0) + [x]
        return out

    def blocks(self, texts: list[str]) -> Iterator[list[np.ndarray]]:
        """The places of each text's pieces in the table, for consecutive runs of texts."""
        at = 0
        while at < len(texts):
            if len(self.begin) > MEMO:
                self._clear()
            parts: list[str | int] = []
            spans: list[tuple[int, int]] = []
            size = 0
            while at < len(texts) and (not spans or size < BLOCK):
                own = self._segments(texts[at])
                spans.append((len(parts), len(parts) + len(own)))
                parts += own
                size += len(texts[at])
                at += 1
            groups: list[list[int]] = [[]]
            filled = 0
            for i, x in enumerate(parts):
                if isinstance(x, str):
                    if groups[-1] and filled + len(x) > 2 * BLOCK:
                        groups.append([])
                        filled = 0
                    groups[-1].append(i)
                    filled += len(x)
            got = {i: np.array([self._special(x)]) for i, x in enumerate(parts) if not isinstance(x, str)}
            for group in filter(None, groups):
                pieces, codes, bounds = self.distinct([parts[i] for i in group])
                places = np.array([self._number(p) for p in pieces], np.int64)
                for k, i in enumerate(group):
                    got[i] = places[codes[bounds[k] : bounds[k + 1]]]
            yield [np.concatenate([got[i] for i in range(a, b)]) for a, b in spans]

    def _special(self, token: int) -> int:
        name = f"\n{token}"  # no piece begins with a line break and goes on with digits
        return self.pieces[name] if name in self.pieces else self._add(name, [token])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """ids of each text in turn."""
        for each in self.blocks(texts):
            flat = np.array(self.flat)
            begin = np.array(self.begin)
            count = np.diff(begin, append=len(flat))
            for codes in each:
                n = count[codes]
                total = int(n.sum())
                index = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[codes], n)
                yield flat[index] if total else np.empty(0, np.uint32)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return b"".join([self.bytes_of[int(i)] for i in ids]).decode("utf-8", "replace")

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids in decimal, SHA-256 of what they decode to) of each text."""
        for each in self.blocks(texts):
            begin = np.array(self.begin)
            count = np.diff(begin, append=len(self.flat))
            decimal, data = self.decimal, self.data
            for a, n in zip(begin[len(decimal) :].tolist(), count[len(decimal) :].tolist()):
                ids = self.flat[a : a + n].tolist()
                decimal.append(",".join(map(str, ids)))
                data.append(b"".join([self.bytes_of[i] for i in ids]))
            for codes in each:
                places = codes.tolist()
                back = b"".join([data[i] for i in places]).decode("utf-8", "replace").encode()
                yield int(count[codes].sum()), hashlib.sha256(",".join([decimal[i] for i in places]).encode()).hexdigest(), hashlib.sha256(back).hexdigest()


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str | None = None, by_library: bool = False) -> Encoder:
    """One Encoder a process, vocabulary file and way."""
    key = os.fspath(path or default_path()), by_library
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every whole text, decode the ids, and return digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no tokens and the digest of the empty string. Long
    texts are handled in blocks cut between pieces; only a run without any white
    space is held whole, at some 60 bytes a code point.
    Rows are independent, so repeated rows repeat and other columns play no part;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            found = list(coder.digests([t or "" for t in batch.column(1).to_pylist()]))
            columns = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
