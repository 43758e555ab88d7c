"""Evidence archives: a gzipped tar in numbered parts, read against a manifest of its members."""

from __future__ import annotations

import hashlib
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def safe(name: str) -> bool:
    """Whether a member's name stays below where it is unpacked; as texts.safe_relative."""
    return bool(name) and not name.startswith("/") and ".." not in name.split("/") and not set(name) & set(":\\\0")


class _Joined:
    """Files read one after the other as a single stream."""

    def __init__(self, paths: list[str]):
        self.rest, self.now = list(paths), None

    def read(self, n: int = -1) -> bytes:
        out = b""
        while n < 0 or len(out) < n:
            if self.now is None:
                if not self.rest:
                    break
                self.now = open(self.rest.pop(0), "rb")
            part = self.now.read(-1 if n < 0 else n - len(out))
            if part:
                out += part
            else:
                self.now.close()
                self.now = None
        return out


def members(parts: list[str], listed: dict[str, tuple[int, str]]) -> Iterator[tuple[str, bytes]]:
    """name, content of the members of an archive in parts, in order.

    Every member must be listed with its size and SHA-256, a plain file, of a safe
    name and there once, and every listed one must be there; else it is an error.
    """
    seen = set()
    with tarfile.open(fileobj=_Joined(parts), mode="r|gz") as archive:
        for member in archive:
            name = member.name
            if not safe(name) or not member.isfile() or name not in listed or name in seen:
                raise ValueError(f"member {name!r} does not belong in the archive")
            content = archive.extractfile(member).read()
            if (len(content), hashlib.sha256(content).hexdigest()) != tuple(listed[name]):
                raise ValueError(f"member {name!r} has another size or digest than the manifest")
            seen.add(name)
            yield name, content
    if missing := sorted(set(listed) - seen):
        raise ValueError(f"members are missing: {missing[:3]}")


def read(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """path, bytes, content of the members of archives (name, parts: array of paths that executors can open, listed: map of name to struct of bytes and sha256).

    An archive is one stream and so one task's work; many archives go over many tasks.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            for parts, listed in zip(batch["parts"], batch["listed"]):
                known = {k: (v["bytes"], v["sha256"]) for k, v in (listed.items() if isinstance(listed, dict) else listed)}
                for name, content in members(list(parts), known):
                    yield pd.DataFrame({"path": [name], "bytes": [len(content)], "content": [content]})

    return archives.select("parts", "listed").mapInPandas(run, "path string, bytes long, content binary")
