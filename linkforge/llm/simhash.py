"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. Two fingerprints at 4 or fewer differing bits
have either one equal segment, or two segments with exactly one differing bit each (else the three segments would
differ in 1 + 2 + 2 bits or more). Both cases become equi-joins:

* equal segment: the segment itself is the key, one row for each segment;
* two segments at one bit: the perfect binary (23, 12) Golay code gives each 23-bit word one nearest codeword,
  at distance 3 or less. A word at distance 1 has that codeword at distance 4 or less, and there are at most six
  such codewords (one if the word's own codeword is at distance 2 or less). So one side is filed under the pair of
  its nearest codeword indices, and the other looks under every pair of indices within distance 4: about 28 a pair.

Candidates are verified by XOR and bit count. Groups stay linear: equal fingerprints are one node, every key first
links its members to one hub, and the full search then visits only pairs whose components still differ.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.operators.components import components
from linkforge.scratch import Scratch, shuffled

SEED, SHINGLE, MAX_BITS = 42, 4, 4
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Distinct fingerprints from which keys are long by default: a choice of plan, as the links found are the same.
LONG_FROM = 4_000_000


def fingerprint(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's word shingles as an unsigned integer; 0 for a text without words.

    Null counts as empty. A text of fewer than width words is one shingle, the whole sequence.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = len(words) - width + 1
    starts, ends = (ends - sizes)[:n].tolist(), ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 16384):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + 16384], ends[at : at + 16384], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint's 64 bits as a signed long. Narrow: no shuffle."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    given = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, fp long")


TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def golay() -> tuple[np.ndarray, np.ndarray]:
    """Parity of each 12-bit message, and for each syndrome the error patterns of weight 4 or less (-1: none)."""
    if TABLES:
        return TABLES[0]
    residue = np.zeros(23, np.int64)
    for i in range(23):
        x = 1 << i
        for j in range(i, 10, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - 11)
        residue[i] = x
    bits = np.arange(4096)[:, None] >> np.arange(12) & 1
    parity = np.bitwise_xor.reduce(np.where(bits, residue[11:], 0), axis=1)
    patterns = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    todo = [(0, 0, 0, 0)]  # error, syndrome, weight, next bit
    by_weight: list[list[tuple[int, int]]] = [[] for _ in range(5)]
    while todo:
        e, s, w, at = todo.pop()
        by_weight[w].append((e, s))
        if w < 4:
            todo += [(e | 1 << i, s ^ int(residue[i]), w + 1, i + 1) for i in range(at, 23)]
    for e, s in (x for level in by_weight for x in level):
        patterns[s, used[s]] = e
        used[s] += 1
    TABLES.append((parity, patterns))
    return TABLES[0]


def near_codewords(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance 4 of each 23-bit word, the nearest first; -1 fills the six columns."""
    parity, patterns = golay()
    words = words.astype(np.int64)
    errors = patterns[parity[words >> 11] ^ (words & 2047)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def pieces(at: int, width: int, n: int) -> list[tuple[int, int]]:
    """n runs of bits, as even as can be."""
    cuts = [at + width * i // n for i in range(n + 1)]
    return [(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)]


def bits_of(fps: np.ndarray, at: int, width: int) -> np.ndarray:
    return (fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)


def keys(fps: np.ndarray, probe: bool, long: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the keys under which fingerprints are filed, or (probe) under which they look.

    Short keys have 21 to 24 bits. Long keys have 7 to 9 more, for large tables: at an equal segment one of five runs of the
    other bits is equal too (4 errors), at two segments of one error one of three runs of the third segment (2 errors).
    """
    rows, found = [], []

    def add(tag: int, at: np.ndarray, key: np.ndarray, runs: list[tuple[int, int]]) -> None:
        for k, (first, width) in enumerate(runs if long else [(0, 0)]):
            rows.append(at)
            found.append((np.int64(tag) << 58) | key << 18 | k << 14 | bits_of(fps[at], first, width))

    parts = [bits_of(fps, *x) for x in SEGMENTS]
    for t, x in enumerate(parts):
        others = [s for i, s in enumerate(SEGMENTS) if i != t]
        add(t, np.arange(len(fps)), x, pieces(*others[0], 2) + pieces(*others[1], 3))
    near = [near_codewords(x) for x in parts]
    for t, (a, b) in enumerate(PAIRS, 3):
        for i in range(6 if probe else 1):
            for j in range(6 if probe else 1):
                at = np.flatnonzero((near[a][:, i] >= 0) & (near[b][:, j] >= 0))
                add(t, at, near[a][at, i] << 12 | near[b][at, j], pieces(*SEGMENTS[3 - a - b], 3))
    return np.concatenate(rows), np.concatenate(found)


def keyed(df: DataFrame, probe: bool, long: bool) -> DataFrame:
    """A row (key, and all columns of df) for every key of df's column fp."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows, key = keys(part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), probe, long)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(c.take(pa.array(rows)) for c in part.columns)], ["key", *part.schema.names])

    return df.mapInArrow(run, "key long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))


def near(a: Column, b: Column, bits: int = MAX_BITS) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def linked(nodes: DataFrame, scratch: Scratch, long: bool | None = None) -> DataFrame:
    """(fp, comp) of distinct fingerprints nodes (fp, n): connected components of the links at MAX_BITS or fewer bits.

    long: whether keys are long; by default at LONG_FROM fingerprints or more. The links found are the same.
    """
    if long is None:
        long = nodes.count() >= LONG_FROM
    filed = scratch.keep(keyed(nodes, False, long), "filed")
    hubs = filed.groupBy("key").agg(F.max(F.struct("n", "fp")).alias("hub"), F.count("*").alias("size")).where("size > 1").select("key", F.col("hub.fp").alias("hub"))
    stars = filed.join(shuffled(hubs), "key").where((F.col("fp") != F.col("hub")) & near(F.col("fp"), F.col("hub"))).select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    first = components(stars, scratch)
    label = lambda df: df.join(shuffled(first.select(F.col("v").alias("fp"), "c")), "fp", "left").select(*df.columns, F.coalesce("c", "fp").alias("comp"))
    flat = scratch.keep(label(nodes.select("fp")), "flat")
    comped = scratch.keep(label(filed.select("key", "fp")), "filed")
    scratch.drop(filed)
    # The component with most members of a key is the key's main one; pairs within a component are never visited,
    # and a key with one member is verified on sight.
    by_comp = comped.groupBy("key", "comp").agg(F.count("*").alias("m"), F.max("fp").alias("one"))
    main = by_comp.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("m").alias("members"), F.max("one").alias("one"))
    main = main.select("key", F.col("top.comp").alias("main"), "comps", "members", "one")
    looks = keyed(flat, True, long).join(shuffled(main), "key").where((F.expr("comp <> main or comps > 1")) & ((F.col("members") > 1) | near(F.col("fp"), F.col("one"))))
    sides = F.when(F.col("comp") == F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    looks = scratch.keep(looks.select("key", F.col("fp").alias("x"), F.col("comp").alias("cx"), F.explode(sides).alias("in_main")), "looks")
    held = comped.join(shuffled(main), "key").select("key", F.col("fp").alias("y"), F.col("comp").alias("cy"), (F.col("comp") == F.col("main")).alias("in_main"))
    rest = looks.join(shuffled(held), ["key", "in_main"]).where((F.col("cx") != F.col("cy")) & near(F.col("x"), F.col("y"))).select(F.least("cx", "cy").alias("a"), F.greatest("cx", "cy").alias("b"))
    second = components(rest, scratch)
    scratch.drop(looks)
    scratch.drop(comped)
    return scratch.keep(flat.join(shuffled(second.select(F.col("v").alias("comp"), "c")), "comp", "left").select("fp", F.coalesce("c", "comp").alias("comp")), "linked")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", long: bool | None = None) -> DataFrame:
    """One row for each row of df: id_col, fingerprint (16 hex digits), component_id (smallest id reachable).

    Whole texts; null and word-less texts have fingerprint zero, linked like any other. Null ids are never the
    smallest (a component of null ids alone has a null component_id). Repeated rows stay. Other columns of df are
    not read, so their names can't clash. An empty table gives an empty result. long: as for linked().
    """
    scratch = Scratch(df.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(df, id_col, text_col), "rows")
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "nodes")
    comps = linked(nodes.select("fp", "n"), scratch, long)
    low = nodes.select("fp", "low").join(shuffled(comps), "fp")
    final = low.join(shuffled(low.groupBy("comp").agg(F.min("low").alias("component_id"))), "comp").select("fp", "component_id")
    return rows.join(shuffled(final), "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", long: bool | None = None) -> DataFrame:
    """The rows of df, with its columns, that stay: of each component one row, that with the smallest id.

    Rows that repeat the kept id with the same fingerprint are cut to the one with the smallest text; a null id is
    kept only where a component has no other. Texts move in one shuffle, on the id (repeated and null ids: on the
    id and the fingerprint). An empty table gives an empty one; other columns may have any names. long: as for linked().
    """
    scratch = Scratch(df.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(df, id_col, text_col), "rows")
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "nodes")
    comps = linked(nodes.select("fp", "n"), scratch, long)
    best = nodes.select("fp", "low").join(shuffled(comps), "fp").groupBy("comp").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "fp")).alias("k"))
    best = best.select(F.col("k.low").alias("id"), F.col("k.fp").alias("fp"))
    repeated = scratch.keep(rows.groupBy("id").count().where("count > 1 or id is null").select("id"), "repeated")
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    back = [F.col(f"row.`{c}`").alias(c) for c in df.columns]
    once = best.where("id is not null").join(shuffled(repeated), "id", "left_anti")
    out = named.join(shuffled(once.select("id")), "id", "left_semi").select(*back)
    if repeated.isEmpty():
        return out
    odd = best.join(shuffled(repeated.where("id is not null")), "id", "left_semi").unionByName(best.where("id is null"))
    some = named.join(shuffled(repeated.where("id is not null")), "id", "left_semi").unionByName(named.where("id is null")).withColumn("fp", fingerprint_column()(F.col("text").cast("binary")))
    some = some.join(shuffled(odd.select(F.col("id").alias("best"), "fp")), (some["id"].eqNullSafe(F.col("best"))) & (some["fp"] == odd["fp"])).select(some["fp"], "id", "text", "row")
    some = some.groupBy("fp", "id").agg(F.min_by("row", F.struct(F.coalesce("text", F.lit("")), F.xxhash64("row"))).alias("row"))
    return out.unionByName(some.select(*back))


def fingerprint_column():
    """fingerprint() as an Arrow-batched column function."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64), dtype="int64")

    return of
