import re
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash

from linkforge.llm import mixing, quality

pipeline = pytest.importorskip("corpus_pipeline")
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, before, sf).write.parquet(out := str(tmp_path / f"{k}-{name}"))
        after = spark.read.parquet(out)
        assert after.count() <= before.count()
        if k < len(pipeline.STAGES) - 1:
            assert after.columns == docs.columns
            assert after.join(docs, docs.columns, "left_anti").isEmpty()
        before = after
    assert {r["law"] for r in before.collect()} == {"key"}


def plain_quality(text):
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    words = [w for w in re.split(f"[{BLANKS}]+", text) if w]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeats = len({i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)})

    def fails(x):
        n = sum(1 for w in re.split(f"[{BLANKS}]", x) if w and set(w) <= set("|»›•·>/"))
        menu = n >= 2 and 3 * n >= len(x.split())
        phrase = len(x) <= 200 and any(p in x.lower() for p in quality.BOILERPLATE)
        end = re.search(rf"[.!?…。！？][\"'”’»)\]]*([{BLANKS}]|\Z)", x)
        return not end or menu or phrase or not any(unicodedata.category(c)[0] in "LN" for c in x)

    lost = sum(len(x) for x in lines if fails(x))
    return len(words) >= 50 and 100 * repeats <= 50 * len(words) and 100 * lost <= 50 * sum(map(len, lines))


def plain_simhash(text):
    words = text.encode().lower().split()
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_dedup(rows):
    fps = {i: plain_simhash(r["text"]) for i, r in rows.items()}
    kept, left = set(), set(rows)
    while left:
        low = min(left)
        kept.add(low)
        todo = [low]
        left.remove(low)
        while todo:
            x = todo.pop()
            near = {y for y in left if (fps[x] ^ fps[y]).bit_count() <= 4}
            left -= near
            todo += near
    return kept


def plain_holds(text, item):
    part = np.array(list(text)) if text else np.array([], str)
    row, steps = np.zeros(len(part) + 1, int), np.arange(len(part) + 1)
    for i, c in enumerate(item, 1):
        new = np.r_[i, np.minimum(row[:-1] + (part != c), row[1:] + 1)]
        row = np.minimum.accumulate(new - steps) + steps
    return row.min() <= len(item) * 8 // 100


def plain_mix(rows):
    tokens = {i: len([w for w in re.split(f"[{BLANKS}]+", r["text"]) if w]) for i, r in rows.items()}
    leaf = lambda r: (f"d{int(m[1]) % 4}" if (m := re.search(r"(\d+)\Z", r["source"])) else "other", r["lang"], r["source"])
    members = {}
    for i, r in rows.items():
        members.setdefault(leaf(r), []).append(i)

    def fill(budget, paths, depth):
        if depth == 3:
            return {paths[0]: budget}
        kids = {k: [p for p in paths if p[depth] == k] for k in {p[depth] for p in paths}}
        room = {k: sum(tokens[i] for p in v for i in members[p]) for k, v in kids.items()}
        weight = {k: mixing.LANG_WEIGHTS.get(k, 1) if depth == 1 else 1 for k in kids}
        given, alive = dict.fromkeys(kids, 0), {k for k in kids if room[k]}
        while full := {k for k in alive if room[k] * sum(weight[x] for x in alive) <= budget * weight[k]}:
            given |= {k: room[k] for k in full}
            alive, budget = alive - full, budget - sum(room[k] for k in full)
        part = {k: budget * weight[k] // sum(weight[x] for x in alive) for k in alive}
        over = budget - sum(part.values()) if alive else 0
        given |= {k: part[k] + (n < over) for n, k in enumerate(sorted(alive))}
        return {p: b for k, v in kids.items() for p, b in fill(given[k], v, depth + 1).items()}

    def key(i):
        h = xxhash.xxh64_intdigest(rows[i]["text"].encode(), 42)
        out = 42
        for raw in ((42).to_bytes(4, "little"), bytes(8), i.to_bytes(8, "little"), h.to_bytes(8, "little")):
            out = xxhash.xxh64_intdigest(raw, out)
        return out - (out >> 63 << 64)

    kept = set()
    for p, b in fill(int(0.8 * sum(tokens.values())), list(members), 0).items():
        if b == sum(tokens[i] for i in members[p]):
            kept |= set(members[p])
            continue
        for i in sorted((i for i in members[p] if tokens[i]), key=key):
            if (b := b - tokens[i]) < 0:
                break
            kept.add(i)
    return kept


def plain_shard(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_rows_against_plain(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    items = [re.sub(r"[\W_]+", " ", r["text"].lower()).strip() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == docs.count()
    steps = {
        "quality_rules": lambda rows: {i for i, r in rows.items() if plain_quality(r["text"])},
        "simhash_dedup": plain_dedup,
        "decontamination": lambda rows: {i for i, r in rows.items() if not any(plain_holds(re.sub(r"[\W_]+", " ", r["text"].lower()).strip(), x) for x in items)},
        "mixing": plain_mix,
    }
    for name, stage in pipeline.STAGES[:-1]:
        kept = steps[name](rows)
        stage(spark, docs, str(tmp_path)).write.parquet(out := str(tmp_path / f"stage-{name}"))
        docs = spark.read.parquet(out)
        assert sorted(r["doc_id"] for r in docs.collect()) == sorted(kept), name
        assert len(kept) < len(rows) and kept, name
        rows = {i: rows[i] for i in kept}
    want = sorted((i, len(r["text"].encode()) + 1, zlib.crc32(r["text"].encode()), plain_shard(i, 16), plain_shard(i, 17)) for i, r in rows.items())
    for got in (pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect(), pipeline.run(spark, str(tmp_path)).collect()):
        assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
        for s in range(16):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(x[3] == s for x in want)))


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, empty and very long texts, columns with clashing names: every stage ends, a row
    of the result is a row that came in, and what must stay stays."""
    good = "\n".join(f"The w{i} a{i} b{i} c{i} d{i} e{i}." for i in range(12))
    long = "\n".join(f"Sentence k{i} with l{i} and m{i} ends." for i in range(20000))
    rows = [(1, good, "en", "src1", 5, "a", "b"), (1, good, "en", "src1", 5, "a", "b"), (None, good.replace("w", "v"), None, None, None, None, None), (2, None, "en", "src1", 0, "x", "x"), (3, "", None, "src2", 0, None, None), (4, " \n\t", "de", None, 3, None, "y"), (5, long, "fr", "src3", len(long), "c", "d"), (6, good.replace("a", "q"), None, "x", None, "e", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality string, shard string"
    spark.createDataFrame([(1, None), (None, "x" * 50), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, given in (("odd", spark.createDataFrame(rows, schema)), ("empty", spark.createDataFrame([], schema))):
        before = given
        for stage_name, stage in pipeline.STAGES:
            stage(spark, before, str(tmp_path)).write.parquet(out := f"{tmp_path}/{name}-{stage_name}")
            after = spark.read.parquet(out)
            if stage_name != "sharding":
                assert after.columns == given.columns and after.exceptAll(before).isEmpty()
                if name == "odd" and stage_name == "quality_rules":
                    assert sorted(str(r["doc_id"]) for r in after.collect()) == ["1", "1", "5", "6", "None"]
                if name == "odd" and stage_name == "simhash_dedup":
                    assert sorted(str(r["doc_id"]) for r in after.collect()) == ["1", "5", "6", "None"]
            before = after
        assert (before.count() > 0) == (name == "odd") and set(before.columns) >= {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
