"""Filling containers of a fixed number of tokens: shortest-pack-first over the histogram of lengths.

Only the histogram (at most ``capacity`` rows) reaches the driver. Packing it
yields patterns, each a list of lengths and how many containers are filled
that way; documents take the places of their length in the patterns by rank.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from ..session import cut

CAPACITY = 2048
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
_ENC: dict[str, object] = {}


def tokenizer_path(name: str = TOKENIZER, folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


# Fixed value: the split pattern the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` of every row; 0 for null and empty texts."""
    path = path or tokenizer_path()

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(path, PATTERN)
        for pdf in it:
            yield pd.DataFrame({"doc_id": pdf["i"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["t"]]})

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInPandas(count, "doc_id long, n_tokens long")


def pack_histogram(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns ``(lengths, containers)`` that place every length of the histogram.

    Lengths go longest first into the pack that is shortest so far, as long as
    that has room; only a pack that the length would fill exactly comes first.
    Each step moves whole counts of equal packs, so the work depends on the
    number of different lengths and not on the number of documents.
    """
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if not room:
            done.append((lengths, n))
            return
        if room not in packs:
            packs[room] = []
            insort(rooms, room)
        packs[room].append((lengths, n))

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):  # no pack has room: new ones, as full of this length as it goes
                each = capacity // length
                if left // each:
                    put(capacity - each * length, (length,) * each, left // each)
                if left % each:
                    put(capacity - left % each * length, (length,) * (left % each), 1)
                break
            room = rooms[k] if rooms[k] == length else rooms[-1]
            lengths, n = packs[room].pop()
            if not packs[room]:
                del packs[room]
                rooms.remove(room)
            use = min(n, left)
            if n > use:
                put(room, lengths, n - use)
            put(room - length, (*lengths, length), use)
            left -= use
    return done + [x for ps in packs.values() for x in ps]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: the ranks where its runs of slots begin, the container at each begin and the token offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for lengths, n in patterns:
        at = 0
        for x in lengths:
            runs.setdefault(x, []).append((n, base, at))
            at += x
        base += n
    out = {}
    for x, rs in runs.items():
        ns = np.array([r[0] for r in rs], dtype=np.int64)
        out[x] = (np.concatenate([[0], np.cumsum(ns)[:-1]]), np.array([r[1] for r in rs], dtype=np.int64), np.array([r[2] for r in rs], dtype=np.int64))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``container_id, offset, doc_id, part, tok_start, n_tokens``: every document in one container, or several if longer than one.

    A text is cut only if it alone exceeds ``capacity``: into full containers
    and a rest, ``part`` 0, 1, ... from ``tok_start`` on. ``offset`` is the
    place in the container. Null and empty texts have no tokens, take no room
    and are given container 0. Repeated rows are separate items; other
    columns are ignored. No rows in give no rows out.
    """
    parts = token_counts(docs, path).select(
        "doc_id", F.posexplode(F.when(F.col("n_tokens") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(capacity).cast("long")),
            lambda at: F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - at)))).alias("part", "n_tokens"),
    )
    parts = cut(parts)
    total = parts.count()
    buckets = max(8, total // rows_per_bucket)
    parts = parts.withColumn("b", F.pmod(F.xxhash64("doc_id", "part"), F.lit(buckets)).cast("int"))
    counts = cut(parts.groupBy("n_tokens", "b").agg(F.count("*").alias("n")))
    hist = {r.n_tokens: r.n for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(pack_histogram({k: n for k, n in hist.items() if k}, capacity))
    before = F.sum("n").over(W.partitionBy("n_tokens").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("n_tokens", "b", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = parts.withColumn("r", F.row_number().over(W.partitionBy("n_tokens", "b").orderBy("doc_id", "part")) - 1)
    ranked = ranked.join(starts, ["n_tokens", "b"]).select("doc_id", "part", "n_tokens", (F.col("first") + F.col("r")).alias("rank"))

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            box, off = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            n, r = pdf["n_tokens"].to_numpy(), pdf["rank"].to_numpy()
            for x in np.unique(n):
                if x:
                    m = n == x
                    first, base, at = slots[int(x)]
                    k = np.searchsorted(first, r[m], side="right") - 1
                    box[m], off[m] = base[k] + r[m] - first[k], at[k]
            yield pd.DataFrame({"container_id": box, "offset": off, "doc_id": pdf["doc_id"], "part": pdf["part"], "tok_start": pdf["part"] * capacity, "n_tokens": n})

    return ranked.mapInPandas(place, "container_id long, offset long, doc_id long, part int, tok_start long, n_tokens long")
