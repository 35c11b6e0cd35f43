"""URL rules by a sorted digest array.

A rule is a host, a path and a verdict; it fits its host and all subdomains where the url's path starts
with its own.  Rules become a file: their 64-bit xxhash keys sorted, and their strings in the same order.  Spark
ships the file to every executor once, where tasks map it into memory.  A url's candidates (each suffix of
its host at a dot, up to the length of the longest rule's host, with each prefix of its path that is as
long as some rule's) are probed by vectorised binary search; equal keys count only if the stored string is
equal too.  The longest rule wins.

The file is bounded by `MAX_INDEX_BYTES` (an error beyond it).  Defined results: a null url or one without
`://` has empty host and path; of repeated rules the blocking one counts; rules of equal length: the
longer host wins; a url without a rule is allowed; other columns are ignored; of a very long url only suffixes
and prefixes of lengths that rules have are probed; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import re
import struct
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_INDEX_BYTES = 512 << 20
MAX_CANDIDATES = 200_000
JUDGED_DDL = "page_id long, host string, path string, rule string, verdict string"
URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
UPPER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first `://` up to `/`, `?`, `#`, with A-Z lower-cased; path: then up to `?`, `#`."""
    found = URL.search(url or "")
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


def digest(host: str, path: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(f"{host} {path}".encode("utf-8", "surrogatepass"))


def index_bytes(rules: list[tuple[str, str, str]]) -> bytes:
    """Counts and the longest host, keys, ends of the strings, path lengths in use, strings (verdict letter, host, space, path)."""
    verdicts: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        key = ((host or "").translate(UPPER), path or "")
        verdicts[key] = "block" if "block" in (verdict, verdicts.get(key)) else verdict
    rows = sorted((digest(*key), f"{v[0]}{key[0]} {key[1]}".encode("utf-8", "surrogatepass")) for key, v in verdicts.items())
    lengths = sorted({len(path) for _, path in verdicts})
    keys = np.array([k for k, _ in rows], "<u8").tobytes()
    ends = np.cumsum([len(s) for _, s in rows]).astype("<u8").tobytes() if rows else b""
    out = struct.pack("<QQQ", len(rows), len(lengths), max((len(host) for host, _ in verdicts), default=0)) + keys + ends + np.array(lengths, "<u8").tobytes() + b"".join(s for _, s in rows)
    if len(out) > MAX_INDEX_BYTES:
        raise ValueError(f"the rules take {len(out)} bytes, more than {MAX_INDEX_BYTES}")
    return out


class Index:
    """A memory-mapped rule file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        n, n_lengths, self.longest = struct.unpack_from("<QQQ", self.data)
        self.keys = np.frombuffer(self.data, "<u8", n, 24)
        self.ends = np.frombuffer(self.data, "<u8", n, 24 + 8 * n)
        self.lengths = np.frombuffer(self.data, "<u8", n_lengths, 24 + 16 * n).tolist()
        self.strings = 24 + 16 * n + 8 * n_lengths

    def string(self, row: int) -> bytes:
        begin = int(self.ends[row - 1]) if row else 0
        return self.data[self.strings + begin : self.strings + int(self.ends[row])]

    def candidates(self, host: str, path: str) -> list[tuple[str, str]]:
        """Longest first; of equal length the longer host first."""
        end = host[max(0, len(host) - self.longest - 1) :]  # and the dot before it
        hosts = [host] if len(host) <= self.longest else []
        hosts += [end[m.end() :] for m in re.finditer(r"\.", end)]
        found = [(h, path[:n]) for h in hosts for n in self.lengths if n <= len(path)]
        return sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))

    def judge(self, parsed: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) of each host and path, or None."""
        out: list = [(None, None)] * len(parsed)
        if not len(self.keys):
            return out
        at = 0
        while at < len(parsed):
            owner, options = [], []
            while at < len(parsed) and len(options) < MAX_CANDIDATES:
                own = self.candidates(*parsed[at])
                owner += [at] * len(own)
                options += own
                at += 1
            probes = np.array([digest(*o) for o in options], np.uint64)
            rows = np.searchsorted(self.keys, probes)
            hits = np.flatnonzero(self.keys[np.minimum(rows, len(self.keys) - 1)] == probes)
            for i in hits:
                if out[owner[i]][0] is not None:
                    continue
                wanted, row = "{} {}".format(*options[i]).encode("utf-8", "surrogatepass"), int(rows[i])
                while row < len(self.keys) and self.keys[row] == probes[i]:
                    stored = self.string(row)
                    if stored[1:] == wanted:
                        out[owner[i]] = ("".join(options[i]), "block" if stored[:1] == b"b" else "allow")
                        break
                    row += 1
        return out


@lru_cache(maxsize=8)
def opened(name: str) -> Index:
    return Index(SparkFiles.get(name))


def ship(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """The rule file on every executor; its name."""
    content = index_bytes(rules)
    name = f"urls-{hashlib.sha256(content).hexdigest()[:24]}.bin"
    folder = tempfile.mkdtemp(prefix="ductlake-urls-")
    with open(os.path.join(folder, name), "wb") as file:
        file.write(content)
    if name not in {os.path.basename(p) for p in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule (host and path, else null), verdict of each row."""
    name = ship(pages.sparkSession, rules)

    def run(batches):
        index = opened(name)
        for batch in batches:
            parsed = [host_and_path(u) for u in batch.column(1).to_pylist()]
            judged = index.judge(parsed)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([h for h, _ in parsed], pa.string()), pa.array([p for _, p in parsed], pa.string()),
                pa.array([r for r, _ in judged], pa.string()), pa.array([v or "allow" for _, v in judged], pa.string()),
            ], names=[c.split()[0] for c in JUDGED_DDL.split(", ")])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, JUDGED_DDL)
