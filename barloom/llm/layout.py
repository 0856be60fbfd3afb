"""Duplicates hidden by layout: canonical bytes, recursive radix partitions, counting tries.

A text is reduced to its words (case, blanks and punctuation gone); a text made only of
`Name: value` fields is reduced to its sorted fields.  Canonical texts are partitioned by their
bytes: Spark's range partitioning is the first digit, and inside a task, which sees its range in
order, a bucket that is too large is split by further bytes behind its common prefix until each
fits.  Every bucket is counted in a trie whose terminals hold the copies and the kept id.  Buckets
have the same size whatever the size of the data, and the driver holds no table of them.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import kernel as K
from barloom.llm.neardup import pieces
from barloom.session import HOT_KEYS, HOT_ROWS, input_bytes, ranged, release, spread, written

#: Different texts in one radix bucket from which it is split further.
BUCKET = 50_000
#: Bytes of one step in a trie.
STRIDE = 8

FIELD = re.compile(r"[|;\r\n\x0b\x0c\x85\u2028\u2029]")
HAS_FIELD = re.compile(r"[|;\r\n\x0b\x0c\x85\u2028\u2029]")


def canonical(texts: list[str]) -> list[str]:
    """The canonical form of each text; '' for a text without words."""
    lowered = [t.lower() for t in texts]
    codes, starts = K.flatten(lowered)
    inside = K.word_mask(codes)
    out = codes.copy()
    after = np.concatenate([[False], inside[:-1]]) & ~inside
    out[after] = 32
    ends = np.append(starts[1:], len(codes)) - 1
    keep = inside | after
    keep[ends], out[ends] = True, 10
    forms = [line.rstrip(" ") for line in out[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split("\n")[:-1]]
    for k, t in enumerate(texts):
        if ":" in t and HAS_FIELD.search(t) and (fields := _fields(t)):
            forms[k] = fields
    return forms


def _fields(text: str) -> str | None:
    """Sorted fields of a text that is made only of two or more `Name: value` fields."""
    parts = FIELD.split(text)
    named = [p.partition(":") for p in parts]
    plain = _plain([n[0] for n in named] + parts)
    names, whole = plain[: len(parts)], plain[len(parts) :]
    full = [k for k, w in enumerate(whole) if w]
    if len(full) < 2 or any(not named[k][1] or not names[k] for k in full):
        return None
    return "|".join(sorted(whole[k] for k in full))


_WORD = re.compile(r"(?:[^\W_]|(?<=\d)[.,](?=\d))+")


def _plain(texts: list[str]) -> list[str]:
    return [" ".join(_WORD.findall(t.lower())) for t in texts]


def _digest(form: bytes) -> bytes:
    return hashlib.blake2b(form, digest_size=16).digest()


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: every row with its digest; kind 1: each different form of this partition once, with
    the number of its rows and the least of their ids (counted in memory, written at the end)."""
    names = ["kind", "id", "digest", "form", "n"]
    told: dict[bytes, list] = {}

    def flush():
        keys = list(told)
        rows = pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(keys), np.int32)), pa.array([told[k][1] for k in keys], pa.string()), pa.array([_digest(k) for k in keys], pa.binary()), pa.array(keys, pa.binary()), pa.array([told[k][0] for k in keys], pa.int64())], names
        )
        told.clear()
        return rows

    held = 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for part in pieces(texts):
            digests = []
            for form, i in zip(canonical(texts[part]), ids[part]):
                form = form.encode("utf-8", "surrogatepass")
                digests.append(_digest(form) if form else None)
                if not form:
                    continue
                if (old := told.get(form)) is None:
                    told[form] = [1, i]
                    held += len(form)
                else:
                    old[0] += 1
                    old[1] = min(old[1], i)
            n = len(digests)
            rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(ids[part], pa.string()), pa.array(digests, pa.binary()), pa.nulls(n, pa.binary()), pa.array(np.ones(n, np.int64))], names)
            yield rows.filter(rows.column(2).is_valid())
            if held > 1 << 25:
                yield flush()
                held = 0
    yield flush()


class Trie:
    """A byte trie with path compression; a terminal is [rest, count, least id]."""

    def __init__(self) -> None:
        self.root: dict[bytes, dict | list] = {}

    def add(self, key: bytes, count: int, kept: str) -> None:
        node, at = self.root, 0
        while True:
            step, at = key[at : at + STRIDE], at + STRIDE
            child = node.get(step)
            if child is None:
                node[step] = [key[at:], count, kept]
                return
            if isinstance(child, list):
                rest = child[0]
                if rest == key[at:]:
                    child[1] += count
                    child[2] = min(child[2], kept)
                    return
                child = node[step] = {rest[:STRIDE]: [rest[STRIDE:], child[1], child[2]]}
            node = child

    def terminals(self) -> Iterator[tuple[bytes, int, str]]:
        open_: list[tuple[bytes, dict]] = [(b"", self.root)]
        while open_:
            path, node = open_.pop()
            for step, child in node.items():
                if isinstance(child, list):
                    yield path + step + child[0], child[1], child[2]
                else:
                    open_.append((path + step, child))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def radix_split(forms: list[bytes]) -> list[tuple[int, int]]:
    """Slices of sorted forms by the byte behind their common prefix (none counts as the first byte)."""
    at = common_prefix(forms[0], forms[-1])
    cuts, begin = [], 0
    while begin < len(forms):
        head = forms[begin][: at + 1]
        end = begin + 1
        if len(head) == at + 1:  # all forms that go on with this byte
            end = bisect.bisect_left(forms, head[:-1] + bytes([head[-1] + 1]) if head[-1] < 255 else b"\xff" * (max(map(len, forms[begin:])) + 1), begin)
        cuts.append((begin, end))
        begin = end
    return cuts


def _counted(batches: Iterator[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
    """Forms that more than one row has, from rows sorted by form.

    Open forms are kept as [count, least id]; when they are more than a bucket holds, all buckets of
    the next byte but the last one are complete, so they are counted and let go.
    """
    forms: list[bytes] = []
    facts: list[list] = []

    def count(begin: int, end: int) -> Iterator[tuple[bytes, int, str]]:
        trie = Trie()
        for k in range(begin, end):
            trie.add(forms[k], *facts[k])
        return trie.terminals()

    def out(found: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_digest(f[0]) for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string())], ["digest", "n_copies", "kept"])

    for batch in batches:
        for form, i, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if forms and forms[-1] == form:
                facts[-1][0] += n
                facts[-1][1] = min(facts[-1][1], i)
            else:
                forms.append(form)
                facts.append([n, i])
        while len(forms) > bucket:
            cuts = radix_split(forms)  # at least two, for the forms differ
            for begin, end in cuts[:-1]:
                yield out([f for f in count(begin, end) if f[1] > 1])
            last = cuts[-1][0]
            forms, facts = forms[last:], facts[last:]
    if forms:
        yield out([f for f in count(0, len(forms)) if f[1] > 1])


def layout_duplicates(df: DataFrame, id_col: str, text_col: str, *, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Texts that differ by layout only: (kept: digest, n_copies, kept), (members: id, digest).

    `kept` lists canonical forms with two or more rows; its id is the least.  Rows with a null id or
    text, or without any word, belong to no group.  A repeated row counts as one more copy.  Other
    columns are not read; an empty table gives empty results.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    rows = written(spread(texts).mapInArrow(_forms, "kind int, id string, digest binary, form binary, n long"), "forms")
    forms = rows.filter("kind = 1").select("form", "id", "n")
    members = rows.filter("kind = 0").select("id", "digest")
    counted = ranged(forms, "form", size=input_bytes(forms)).sortWithinPartitions("form").mapInArrow(partial(_counted, bucket=bucket), "digest binary, n_copies long, kept string")
    kept = written(counted, "kept")
    release(spark)
    return kept, members


def copies(kept: DataFrame, members: DataFrame) -> DataFrame:
    """One row per copy that goes: kept, id.  Groups so large that one task should not hold them
    number at most HOT_KEYS; they meet their rows by broadcast, the others by shuffle."""
    total = members.count()
    hot = F.col("n_copies") >= F.lit(max(HOT_ROWS, -(-total // HOT_KEYS)))
    few = members.join(F.broadcast(kept.filter(hot).select("digest", "kept")), "digest")
    many = members.join(kept.filter(~hot).select("digest", "kept"), "digest")
    return few.union(many).filter("id <> kept").select("kept", "id").distinct()
