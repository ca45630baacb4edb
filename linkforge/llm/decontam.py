"""Benchmark decontamination by the q-gram lemma.

If a benchmark passage of m characters occurs in a text with e edits or fewer, the two share at least m - q + 1 - e q
character q-grams, all of them on diagonals (place in the text less place in the passage) within e of one another.
For every passage the shared q-grams are counted in overlapping bands of diagonals, each 2 (e + 1) wide and e + 1 apart, so
any e + 1 neighbouring diagonals lie in one band. Bands that meet the bound are verified by a banded alignment.
Passages with fewer than q characters have no q-gram: they are looked up exactly, between word limits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q, EDIT_PERCENT = 8, 8
#: First and last code points of scripts that are written without spaces: any two characters may be a word limit.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
#: Characters of benchmark text that are sent to the executors at once; a larger benchmark takes several passes.
BLOCK_CHARS = 4_000_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


#: ASCII letters in lower case, digits, and a blank for every other byte.
PLAIN = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256)).lower()


def normal(text: str | None) -> str:
    """Lower case; each run of other characters than letters and digits becomes one space. Null counts as empty."""
    if not text:
        return ""
    if text.isascii():
        return b" ".join(text.encode().translate(PLAIN).split()).decode()
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each q-gram."""
    n = len(c) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q):
            h *= FACTOR
            h += c[i : i + n]
        h ^= h >> np.uint64(29)
        h *= FACTOR
    return h


def budget(m: int, percent: int = EDIT_PERCENT) -> int:
    """Edits allowed for a passage of m characters, never so many that the lemma asks for nothing."""
    return max(0, min(m * percent // 100, (m - Q) // (Q + 1)))


class Index:
    """The q-grams of a block of passages: sorted hashes with passage and place, and a bit table in front of them."""

    BITS = 20

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(k, codes(t)) for k, t in items]
        h, item, place = [], [], []
        short: dict[int, dict[int, list[int]]] = {}
        for i, (_, c) in enumerate(self.items):
            if 0 < len(c) < Q:
                short.setdefault(len(c), {}).setdefault(int(grams(c, len(c))[0]), []).append(i)
        self.short = [(q, np.array(sorted(known), np.uint64), known) for q, known in short.items()]
        for i, (_, c) in enumerate(self.items):
            g = grams(c)
            h.append(g)
            item.append(np.full(len(g), i))
            place.append(np.arange(len(g)))
        self.hash, self.item, self.place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, item, place))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.place = self.hash[order], self.item[order], self.place[order]
        self.known, self.start, self.count = np.unique(self.hash, return_index=True, return_counts=True)
        sizes = [len(c) for _, c in self.items]
        self.edits = np.array([budget(m) for m in sizes], np.int64)
        #: Different q-grams that the lemma asks for.
        self.least = np.array(sizes, np.int64) - Q + 1 - self.edits * Q
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[(self.hash >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def hits(self, g: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, passage, place in the passage) of every shared q-gram."""
        at = np.flatnonzero(self.table[(g >> np.uint64(64 - self.BITS)).view(np.int64)])
        if not len(at):
            return at, at, at
        near = np.minimum(np.searchsorted(self.known, g[at]), len(self.known) - 1)
        same = self.known[near] == g[at]
        at, near = at[same], near[same]
        lo, n = self.start[near], self.count[near]
        rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n) + first, self.item[rows], self.place[rows]


def limits(c: np.ndarray) -> np.ndarray:
    """Whether a word may begin or end before each place of a normalised text, and at its end."""
    out = np.ones(len(c) + 1, bool)
    free = c == 32
    for a, b in UNSPACED:
        free |= (c >= a) & (c <= b)
    out[1:-1] = free[:-1] | free[1:]
    return out


def exact(c: np.ndarray, index: Index) -> dict[int, tuple[int, int]]:
    """(0, first place) of each passage of fewer than Q characters that stands in the text between word limits."""
    out = {}
    cut = limits(c) if index.short else None
    for q, hashes, known in index.short:
        g = grams(c, q)
        if not len(g):
            continue
        near = hashes[np.minimum(np.searchsorted(hashes, g), len(hashes) - 1)]
        at = np.flatnonzero((near == g) & cut[: len(g)] & cut[q : q + len(g)])
        for k in at[np.unique(g[at], return_index=True)[1]].tolist():
            out |= {i: (0, k) for i in known[int(g[k])] if np.array_equal(index.items[i][1], c[k : k + q])}
    return out


def regions(at: np.ndarray, item: np.ndarray, place: np.ndarray, index: Index) -> list[tuple[int, int]]:
    """(passage, lowest diagonal) of the bands with enough different places of the passage."""
    out = []
    due = np.bincount(item, minlength=len(index.items)) >= index.least
    due &= index.least > 0
    if not due.any():
        return out
    kept = due[item]
    at, item, place = at[kept], item[kept], place[kept]
    order = np.argsort(item, kind="stable")
    at, item, place = at[order], item[order], place[order]
    cuts = (np.flatnonzero(np.diff(item)) + 1).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, len(item)], strict=True):
        i = int(item[lo])
        e, least = int(index.edits[i]), int(index.least[i])
        step = e + 1
        band = (at[lo:hi] - place[lo:hi]) // step
        # A diagonal lies in the band that begins at its step, and in the one that begins a step before.
        both = np.unique(np.concatenate([band, band - 1]) * (1 << 24) + np.tile(place[lo:hi], 2))
        found, n = np.unique(both >> 24, return_counts=True)
        out += [(i, int(b) * step) for b in found[n >= least]]
    return out


def aligned(passage: np.ndarray, text: np.ndarray, first: int, last: int, most: int) -> int | None:
    """The fewest edits that turn passage into any run of text, if most or fewer, over the diagonals from first to last
    alone; the runs' ends cost nothing.

    A row holds the costs of one place of the passage on every diagonal, less the diagonal's number: a character kept or
    replaced stays on its diagonal, one left out of the passage comes from the next, and one put in from the one
    before, which is a running minimum then. Before the text nothing begins; after it stands a character of no passage,
    which costs what leaving out a character of the passage costs.
    """
    width, m = last - first + 1, len(passage)
    seen = np.full(m + width, -1, np.int64)
    lo, hi = max(first, 0), min(first + m + width, len(text))
    if hi > lo:
        seen[lo - first : hi - first] = text[lo:hi]
    unequal = (np.lib.stride_tricks.sliding_window_view(seen, width)[:m] != passage.astype(np.int64)[:, None]).astype(np.int32)
    steps = np.arange(width, dtype=np.int32)
    row = np.where(first + steps >= 0, -steps, np.int32(1 << 20)).astype(np.int32)
    left_out = np.empty(width - 1, np.int32)
    for i in range(m):
        np.add(row[1:], 2, out=left_out)
        np.add(row, unequal[i], out=row)
        np.minimum(row[:-1], left_out, out=row[:-1])
        np.minimum.accumulate(row, out=row)
        if i % 16 == 15 and (row + steps).min() > most:
            return None
    cost = int((row + steps).min())
    return cost if cost <= most else None


def find(text: str | None, index: Index, chunk: int = 1 << 20) -> list[tuple[int, int, int, int]]:
    """(item_id, edits, place in the normalised text, length) of each passage in the text, with the fewest edits."""
    c = codes(normal(text))
    parts = [index.hits(grams(c[k : k + chunk + Q - 1]), k) for k in range(0, max(0, len(c) - Q + 1), chunk)]
    best = exact(c, index)
    for i, diagonal in regions(*(np.concatenate(x) for x in zip(*parts, strict=True)), index) if parts else ():
        passage = index.items[i][1]
        e = budget(len(passage))
        if (i in best and best[i][0] == 0) or (cost := aligned(passage, c, diagonal - e, diagonal + 2 * (e + 1) + e, e)) is None:
            continue
        best[i] = min(best.get(i, (cost, max(0, diagonal))), (cost, max(0, diagonal)))
    return [(index.items[i][0], cost, place, len(index.items[i][1])) for i, (cost, place) in sorted(best.items())]


def blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark's distinct passages that have characters, streamed to the driver in blocks of bounded size."""
    given = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct().orderBy("i", "t")
    part, size = [], 0
    for r in given.toLocalIterator():
        t = normal(r["t"])
        if t:
            part.append((r["i"], t))
            size += len(t)
        if size >= BLOCK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, place, length): a row for each passage that a row of docs holds.

    Whole texts; passages of any length, with up to EDIT_PERCENT edits where the lemma allows them and none below Q
    characters. length, of the normalised passage, tells a leak from a phrase. Texts of any length are searched in
    pieces that overlap; null texts count as empty, an empty table on either side gives an empty result,
    benchmark rows with nulls hold no passage. Repeated rows of docs give repeated results; other columns aren't
    read. One narrow pass over docs for every block of the benchmark; no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ik = benchmark.schema[item_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spark, out = docs.sparkSession, None
    for block in blocks(benchmark, item_col, item_text):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            index = Index(sent.value)
            for batch in batches:
                rows = [(d.as_py(), *f) for d, t in zip(batch.column(0), batch.column(1), strict=True) for f in find(t.as_py(), index)]
                cols = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], item_type), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["doc_id", "item_id", "edits", "place", "length"])

        from pyspark.sql.pandas.types import to_arrow_type

        item_type = to_arrow_type(benchmark.schema[item_col].dataType)
        part = given.mapInArrow(run, f"doc_id {kind}, item_id {ik}, edits long, place long, length long")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"doc_id {kind}, item_id {ik}, edits long, place long, length long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with its columns, that hold no passage: narrow, row by row, so null or repeated ids are no matter."""
    out = docs.select(F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    for block in blocks(benchmark, "item_id", "text"):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            index = Index(sent.value)
            for batch in batches:
                yield batch.filter(pa.array([not find(t.as_py(), index) for t in batch.column("text")], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
