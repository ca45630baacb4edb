import os
import random
import uuid
from hashlib import md5
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkforge.files import Files
from linkforge.functions.similarity import jaro_winkler_of
from linkforge.operators.candidates import address_pairs, blocked, blocks, phone_pairs, prepared, theta
from linkforge.operators.components import components
from linkforge.operators.model import Model
from linkforge.operators.review import submit
from linkforge.operators.scoring import scored
from linkforge.plans import batch, queries, views
from linkforge.plans.batch import run_batch
from linkforge.schemas import FIELDS
from linkforge.scratch import Scratch
from linkforge.sources import landing
from linkforge.sources.store import Store

HEAD = ",".join(FIELDS)
FEEDS = {
    "alpha": ['A1,"Orion, ""Best"" Mills Pvt Ltd",PANAA0001A,,12 Lake Road,560001,Textiles,9000000001,2020-01-01', "A2,Nova Foods,,GST0002,5 Hill Street,560002,Food,9000000002,", "", "A3,Peak Steel Works,,,Dock Area,560003,Metal,9000000003", "A4,ಕನ್ನಡ,,,,560009,X,"],
    "beta": ["B1,Orion Mills,panaa0001a ,,12 Lake Road,560001,Textiles,9000000011,2020", "B2,Nova Foods Ltd,,gst0002,Hill Street 5,560002,Food,,", "B3,Peak Steel Works Limited,PANAA0003C,,Dock Area Gate 4,560003,Metal,9000000003,,x,y", "B4,Same Pan Twice,PANAA0009Z,,a,1,b,2", "B5,Same Pan Again,PANAA0009Z,,c,3,d,4"],
}


def land(folder: Path, feeds=FEEDS, marker=True):
    folder.mkdir(parents=True, exist_ok=True)
    for name, rows in feeds.items():
        (folder / f"dept_{name}.csv").write_text("\n".join([HEAD, *rows]) + "\n")
    if marker:
        (folder / "confirmation.txt").write_text("done")


def test_ready(spark, tmp_path):
    files = Files(spark)
    assert not landing.ready(files, f"{tmp_path}/none")
    land(tmp_path, marker=False)
    assert not landing.ready(files, str(tmp_path))
    land(tmp_path)
    assert landing.ready(files, str(tmp_path)) and [f.name for f in landing.manifest(files, str(tmp_path))] == ["dept_alpha.csv", "dept_beta.csv"]


def test_feeds(spark, tmp_path):
    land(tmp_path)
    rows = {r["recordId"]: r for r in landing.read_feeds(spark, [f.path for f in landing.manifest(Files(spark), str(tmp_path))]).collect()}
    assert len(rows) == 9
    assert rows["A1"]["businessName"] == 'Orion, "Best" Mills Pvt Ltd'
    assert rows["B1"]["pan"] == "panaa0001a" and rows["B1"]["registrationDate"] == "" and rows["B1"]["source"] == "beta"
    assert rows["B3"]["registrationDate"] == "x" and rows["A3"]["phone"] == "9000000003"
    assert [r for r in sorted(rows, key=lambda k: rows[k]["ord"])] == ["A1", "A2", "A3", "A4", "B1", "B2", "B3", "B4", "B5"]


def test_fields_against_toggle(spark):
    """Any line, cut by a pattern and by a loop that toggles at each quote."""

    def toggle(line):
        out, now, inside, i = [], "", False, 0
        while i < len(line):
            c = line[i]
            if c == '"':
                if inside and line[i + 1 : i + 2] == '"':
                    now += c
                    i += 1
                else:
                    inside = not inside
            elif c == "," and not inside:
                out.append(now)
                now = ""
            else:
                now += c
            i += 1
        return [x.strip("".join(map(chr, range(33)))) for x in [*out, now]]

    r = random.Random(5)
    lines = ["".join(r.choice('ab,," "\x01\x02$\\é') for _ in range(r.randint(0, 24))) for _ in range(4000)] + ['"""Best"" Mills"', '""', '"', '"""', ',"', "a," * 50_000, '"' * 100_001, '"a""' * 30_000]
    got = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", landing.fields(F.col("line")).alias("f")).collect()
    for row in got:
        assert row["f"] == toggle(lines[row["i"]]), lines[row["i"]][:80]


def test_batch_and_review(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    land(tmp_path / "s/landing")
    (tmp_path / "s/landing/late.csv").write_text("x")
    status = run_batch(store, batch_id="b1")
    assert status.stats == {"totalRecords": 9, "pairsChecked": 20, "autoLinked": 4, "pendingReview": 1, "registrySize": 7}
    assert [x for _, x, _ in status.log] == ["DETECTING", "INGESTING", "MATCHING", "WRITING", "COMPLETE", "IDLE"] and status.state == "IDLE"
    assert '"state":"IDLE"' in views.status_json(status) and f'"lastUpdated":{status.updated},"stats":{{"totalRecords":9' in views.status_json(status)
    assert (tmp_path / "s/landing/late.csv").exists() and not landing.ready(store.files, f"{store.root}/landing")
    rows = store.table("registry").collect()
    twice = [r for r in rows if r["records"][0]["pan"] == "PANAA0009Z"]
    assert len(twice) == 2 and twice[0]["ubid"] == twice[1]["ubid"] and not twice[0]["autoLinked"]
    item = store.queue().first()
    assert item["status"] == "PENDING" and item["record1"]["recordId"] == "A3"
    with pytest.raises(ValueError):
        submit(store, "nobody", "MATCH")
    with pytest.raises(ValueError):
        submit(store, item["id"], "maybe")
    assert submit(store, item["id"], "match", 'a "quote" $1 \\')
    assert not submit(store, item["id"], "match")
    assert store.model().feedback == 1 and store.table("registry").count() == 8
    queue = store.queue().first()
    assert queue["status"] == "REVIEWED" and queue["reviewNote"] == 'a "quote" $1 \\'
    assert views.comparison(store.queue()).where("match").count() > 2
    assert views.pending(store.queue()).isEmpty() and views.progress("WRITING") == 3
    tail = views.registry_tail(store.table("registry"), 2).collect()
    assert tail[-1]["batch_id"] == f"review-{item['id']}" and tail[0]["batch_id"] == "b1"


#: Four feeds with every situation of a real batch: equal keys in four, three and two sources, a key in the wrong column,
#: one side without keys, near misses, abbreviations.
GOLDEN = {
    "east": ["E1,Delta Info Pvt Ltd,DELTA0001A,,1 Tech Park,560001,IT,9100000001", "E2,Amber Textiles,AMBER1234D,,12 Gandhi Road,560002,Textiles,9100000002", "E3,Granite Steel Works,,,7 Dock Area,560003,Metal,9100000003", "E4,Town Bakery Confectionery,,,9 Main Bazaar,560004,Food,9100000004", "E5,Orion Elec,,ORION5678F,4 Market Street,560005,Electronics,9100000055"],
    "north": ["N1,Amber Textile Mills,AMBER1234D,,12 Gandhi Rd,560002,Textiles,9100000002", "N2,Granite Steel Works Ltd,GRANI2222K,,7 Dock Area Phase 2,560003,Metal,9100000003", "N3,Delta Information Systems,DELTA0001A,29D,1 Tech Park Road,560001,IT,9100000001", "N4,Cedar Foods,,29CEDAR001Z3,3 Hill Street,560006,Food,9100000006", "N5,Maple Pharma,MAPLE5555H,,8 Lake View,560007,Pharma,9100000007"],
    "south": ["S1,Orion Electronics,ORION5678F,,Shop 4 Market Street Block,560005,Electronics,9100000005", "S2,G S Works,,,Unit 5,560003,Metal,", "S3,Delta Infotech,DELTA0001A,29D,2 Tech Park,560001,IT,9100000009", "S4,Cedar Food Products,,29CEDAR001Z3,3 Hill Street,560006,Food,9100000006", "S5,Violet Traders,,29VIOLET01Z1,11 River Bank,560008,Trade,9100000010"],
    "west": ["W1,Amber Textiles Pvt Ltd,AMBER1234D,,12 Gandhi Road,560002,Textiles,9100000002", "W2,Orion Electronic Shop,ORION5678F,,99 Ring Circle,560005,Electronics,9100000005", "W3,Town Bakery,TOWNB7777L,,Main Bazaar Corner Shop,560004,Food,", "W4,Delta Info Private Limited,DELTA0001A,,1 Tech Park,560001,IT,9100000001", "W5,Violet Trading House,,29VIOLET02Z1,77 Station Square,560008,Retail,", "W6,Maple Pharmaceuticals,MAPLE5555H,,8 Lake View,560007,Pharma,9100000007"],
}


def test_golden_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    land(tmp_path / "s/landing", GOLDEN)
    status = run_batch(store)
    assert status.batch_id.startswith("batch-") and status.stats == {"totalRecords": 21, "pairsChecked": 165, "autoLinked": 13, "pendingReview": 2, "registrySize": 13}
    rows = {tuple(m["recordId"] for m in r["records"]): r for r in store.table("registry").collect()}
    assert sorted(k for k in rows if len(k) > 1) == [("E1", "N3", "S3", "W4"), ("E2", "N1", "W1"), ("N4", "S4"), ("N5", "W6"), ("S1", "W2")]
    assert sorted(k[0] for k in rows if len(k) == 1) == ["E3", "E4", "E5", "N2", "S2", "S5", "W3", "W5"]
    name_id = lambda key: str(uuid.UUID(bytes=md5(f"UBID:{key}".encode()).digest(), version=3))
    assert rows["E1", "N3", "S3", "W4"]["ubid"] == name_id("DELTA0001A") and rows["N4", "S4"]["ubid"] == name_id("29CEDAR001Z3")
    assert rows["E5",]["ubid"] == rows["S1", "W2"]["ubid"] == name_id("ORION5678F")  # the key stands in the wrong column: not linked
    assert rows["E1", "N3", "S3", "W4"]["evidence"] == "Name: 1.00, PAN: match, Address: 1.00, PinCode: match, Sector: match, Phone: match"
    assert rows["E3",]["evidence"] == "No matching records found" and rows["E1", "N3", "S3", "W4"]["sources"] == ["east", "north", "south", "west"]
    items = {(r["record1"]["recordId"], r["record2"]["recordId"]): r for r in store.queue().collect()}
    assert {k: r["score"] for k, r in items.items()} == {("E3", "N2"): 0.59, ("E5", "S1"): 0.5653}  # phones one digit apart count
    assert items["E5", "S1"]["evidence"] == "Name: 0.92, Address: 0.60, PinCode: match, Sector: match, Phone: match"
    assert submit(store, items["E3", "N2"]["id"], "MATCH")
    decided = store.table("registry").where("humanVerified").first()
    assert decided["ubid"] == name_id("GRANI2222K") and decided["sources"] == ["east", "north"] and decided["score"] == 0.59


LINKS: dict = {}


@pytest.fixture
def quick_link(spark, monkeypatch):
    """Links equal records once a session: for tests of what comes after."""
    plain = batch.link

    def link(records, model, scratch, reviews=True):
        key = tuple(sorted(map(str, records.drop("ord").collect())))
        if key not in LINKS:
            LINKS[key] = plain(records, model, Scratch(spark, "links"), reviews)
        return LINKS[key]

    monkeypatch.setattr(batch, "link", link)


def test_retry_adds_nothing(spark, tmp_path, quick_link):
    store = Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        land(tmp_path / "s/landing")
        run_batch(store, batch_id="same")
    assert store.table("registry").count() == 7


class Crash(Exception):
    pass


def crash_after(monkeypatch, at):
    """Every write of a store, commit or archive counts; the one with number at is the last that is done."""
    done = [0]

    def counted(owner, name):
        plain = getattr(owner, name)

        def call(*args, **kw):
            if done[0] >= at:
                raise Crash
            out = plain(*args, **kw)
            done[0] += 1
            return out

        monkeypatch.setattr(owner, name, call)

    for owner, name in ((Store, "put"), (Store, "commit"), (Files, "move")):
        counted(owner, name)


@pytest.mark.parametrize("at", range(6))
def test_batch_survives_a_crash_after_each_write(spark, tmp_path, quick_link, at):
    """registry, review items, commit, two feeds and the marker of the archive: whatever is done, a second run ends it."""
    store = Store(spark, str(tmp_path / "s"))
    land(tmp_path / "s/landing")
    with pytest.MonkeyPatch.context() as patch, pytest.raises(Crash):
        crash_after(patch, at)
        run_batch(store)
    assert store.table("registry").count() == (7 if at > 2 else 0)
    run_batch(Store(spark, str(tmp_path / "s")))
    again = Store(spark, str(tmp_path / "s"))
    assert again.table("registry").count() == 7 and again.table("review_items").count() == 1 and len(again.log()) == 1
    assert not any((tmp_path / "s/landing").iterdir())
    land(tmp_path / "s/landing", {"alpha": FEEDS["alpha"], "gamma": FEEDS["beta"]})
    run_batch(again)
    assert again.table("registry").count() == 14 and len(again.log()) == 2


@pytest.mark.parametrize("at", range(3))
def test_review_survives_a_crash_after_each_write(spark, tmp_path, quick_link, at):
    store = Store(spark, str(tmp_path / "s"))
    land(tmp_path / "s/landing")
    run_batch(store)
    id_ = store.queue().first()["id"]
    with pytest.MonkeyPatch.context() as patch, pytest.raises(Crash):
        crash_after(patch, at)
        submit(store, id_, "MATCH")
    assert store.model().feedback == 0 and store.table("registry").count() == 7 and store.queue().first()["status"] == "PENDING"
    assert submit(store, id_, "NO_MATCH")
    assert store.model().feedback == 1 and store.table("registry").count() == 9 and store.queue().first()["decision"] == "NO_MATCH"


def test_two_reviewers_lose_no_weight(spark, tmp_path, quick_link, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    land(tmp_path / "s/landing", {x: ["1,Peak Steel Works,,,Dock Area,560003,Metal,9000000003", "2,Lone Star,,,Lake Road,560004,Metal,9000000007"] for x in ("alpha", "beta")})
    run_batch(store)
    first, second = (r["id"] for r in store.queue().collect())
    plain, other = Store.commit, []

    def late(self, *args, **kw):
        if not other:
            other.append(submit_other())
        return plain(self, *args, **kw)

    def submit_other():
        monkeypatch.setattr(Store, "commit", plain)
        try:
            return submit(Store(spark, store.root), second, "MATCH")
        finally:
            monkeypatch.setattr(Store, "commit", late)

    monkeypatch.setattr(Store, "commit", late)
    assert submit(store, first, "MATCH") and other == [True]
    assert store.model().feedback == 2 and store.queue().where("status = 'REVIEWED'").count() == 2


def test_snapshots_read_alike(spark, tmp_path, quick_link):
    store = Store(spark, str(tmp_path / "s"))
    for n in range(3):
        land(tmp_path / "s/landing")
        run_batch(store, batch_id=f"b{n}")
        if n == 0:
            submit(store, store.queue().first()["id"], "MATCH")
    key = lambda s: [sorted(map(str, s.table(t).select("batch_id", "commit", *(c for c in s.table(t).columns if c not in ("batch_id", "commit"))).collect())) for t in ("registry", "review_items", "review_decisions")]
    before = key(store)
    for _ in range(2):
        store.compact()
        assert key(store) == before and store.log() == {} and store.model().feedback == 1 and store.head() == 4
    store.vacuum()
    again = Store(spark, store.root)
    assert key(again) == before and again.committed("b1") and not again.committed("b7") and not os.listdir(tmp_path / "s/commits")
    land(tmp_path / "s/landing")
    run_batch(again, batch_id="b3")
    again.compact()
    again.vacuum()
    assert again.table("registry").count() == 29 and again.head() == 5 and again.committed("b0")
    again.reset()
    assert again.table("registry").isEmpty() and again.model().feedback == 0


def test_stream(spark, tmp_path, quick_link):
    from linkforge.streaming.batches import start

    store = Store(spark, str(tmp_path / "s"))
    for n in ("one", "two"):
        land(tmp_path / f"s/landing/batch={n}")
        start(store, str(tmp_path / "ckpt")).awaitTermination()
    assert store.table("registry").count() == 14
    (tmp_path / "s/landing/batch=three").mkdir()
    (tmp_path / "s/landing/batch=three/confirmation.txt").write_text("done")
    with pytest.raises(Exception, match="three"):  # the marker came before its feeds
        start(store, str(tmp_path / "ckpt")).awaitTermination()
    land(tmp_path / "s/landing/batch=three", marker=False)
    start(store, str(tmp_path / "ckpt")).awaitTermination()
    assert store.table("registry").count() == 21


def random_records(spark, seed, n=60):
    r = random.Random(seed)
    names, words = ["orion mills", "nova foods", "peak steel", "", "zen co"], ["lake", "road", "hill", "dock", "gate", "main"]
    rows = []
    for i in range(n):
        src = r.choice("abc")
        rows.append((f"{src}{i:04d}", src, f"R{i}", r.choice(names), r.choice(["", "P1", "p2"]), r.choice(["", "", "G1"]), " ".join(r.sample(words, r.randint(0, 4))) or r.choice(["", "--"]), str(r.randint(1, 4)), r.choice("st"), str(r.randint(100, 103)), ""))
    return spark.createDataFrame(rows, "ord string, source string, " + ", ".join(f"{f} string" for f in FIELDS))


WEIGHTS = [None, (0.2, 0.2, 0.3, 0.1, 0.1, 0.1), (0.1, 0.5, 0.1, 0.1, 0.1, 0.1), (0.34, 0.29, 0.14, 0.11, 0.06, 0.06), (0.3, 0.2, 0.3, 0.1, 0.05, 0.05), (0.5, 0.1, 0.1, 0.1, 0.1, 0.1), (0.2, 0.1, 0.5, 0.1, 0.05, 0.05), (0.1, 0.6, 0.1, 0.1, 0.05, 0.05)]


@pytest.mark.parametrize(("seed", "weights"), list(enumerate(WEIGHTS)))
def test_blocking_loses_nothing(spark, seed, weights):
    """Against the theta join: hot pin codes, empty and punctuation-only addresses, near phones, weights that drift."""
    model = Model() if weights is None else Model(dict(zip(Model().weights, weights, strict=True)))
    recs = prepared(random_records(spark, seed, 90)).persist()
    full = scored(recs, theta(recs), model, prune=False).where("zone <> 'SEPARATE'")
    few = scored(recs, blocked(recs, model), model).where("zone <> 'SEPARATE'")
    key = lambda df: sorted(map(tuple, df.select("ord1", "ord2", F.round("score", 9), "zone").collect()))
    assert key(few) == key(full) and full.count() > 0
    assert (blocks(model) is None) == (weights is not None and weights[1] > 0.5)


def test_blocks_after_learning(spark):
    """Weights as decisions move them, at every step of a long run of them."""
    r, model = random.Random(3), Model()
    recs = prepared(random_records(spark, 11, 70)).persist()
    for k in range(24):
        model = model.learned({f: r.random() for f in ("identifier", "name", "address", "pinCode", "sector", "phone")}, r.random() < 0.7)
        if k % 8 == 7:
            full = scored(recs, theta(recs), model, prune=False).where("zone <> 'SEPARATE'").select("ord1", "ord2")
            few = scored(recs, blocked(recs, model), model).where("zone <> 'SEPARATE'").select("ord1", "ord2")
            assert sorted(map(tuple, few.collect())) == sorted(map(tuple, full.collect()))


def test_address_pairs_against_theta(spark):
    recs = prepared(random_records(spark, 21, 80)).persist()
    rows = recs.select("ord", "source", "at").collect()
    want = sorted((a["ord"], b["ord"]) for a in rows for b in rows if a["source"] < b["source"] and a["at"] and b["at"] and 2 * len(set(a["at"]) & set(b["at"])) >= len(set(a["at"]) | set(b["at"])))
    assert sorted((x["o1"], x["o2"]) for x in address_pairs(recs, 0.5).collect()) == want and len(want) > 50


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {v: c for v, c in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}


def test_phone_pairs_lose_nothing(spark):
    phones = ["9000000001", "9000000002", "900000001", "19000000001", "9000000021", "9000000012", "", "", "7", "8", "78", "é1", "1", " 9000000001 "]
    rows = [(f"{s}{i}", s, f"R{i}", "", "", "", "", str(i), "", p, "") for i, p in enumerate(phones) for s in "abc"]
    recs = prepared(spark.createDataFrame(rows, "ord string, source string, " + ", ".join(f"{f} string" for f in FIELDS)))

    def near(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1] <= 1

    want = sorted((r[0], q[0]) for r in rows for q in rows if r[1] < q[1] and r[9].strip() and q[9].strip() and near(r[9].strip(), q[9].strip()))
    assert sorted(map(tuple, phone_pairs(recs).collect())) == want and len(want) > 50


def test_phone_query_finds_near_phones(spark):
    sf = "/root/testdata/sf0.001"
    f = queries.feed(spark, sf).select("ord", "source", "phone").collect()
    edits = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    # All phones of the feed have ten digits; a pair one insertion and one deletion apart has two edits.
    want = sorted((a["ord"], b["ord"]) for a in f for b in f if a["source"] < b["source"] and edits(a["phone"], b["phone"]) <= 1)
    assert sorted(map(tuple, queries.phone_near_match(spark, sf).collect())) == want
    assert any(a[-19:] != b[-19:] for a, b in want)


def test_feature_queries_see_every_pair(spark):
    sf = "/root/testdata/sf0.001"
    recs = prepared(queries.feed(spark, sf)).persist()
    f = {r["ord"]: r for r in recs.collect()}
    pairs = [(a, b) for a in f for b in f if f[a]["source"] < f[b]["source"]]
    got = {(r["o1"], r["o2"]): r["jaccard"] for r in queries.token_jaccard_pairs(spark, sf).collect()}
    scores = {(r["o1"], r["o2"]): r["score"] for r in queries.scored_pairs_all(spark, sf).collect()}
    cheap = {(r["o1"], r["o2"]): r["score"] for r in queries.scored_pairs_cheap(spark, sf).collect()}
    assert sorted(got) == sorted(scores) == sorted(pairs) and cheap == {p: scores[p] for p in cheap} and len(cheap) < len(pairs)
    for a, b in pairs:
        x, y = set(f[a]["at"]), set(f[b]["at"])
        if x and y:
            assert got[a, b] == round(len(x & y) / len(x | y), 9)
    names = {(r["n1"], r["n2"]): r["similarity"] for r in queries.jaro_winkler_names(spark, sf).collect()}
    assert names == {(f[a]["n"], f[b]["n"]): round(jaro_winkler_of(f[a]["n"], f[b]["n"]), 9) for a, b in pairs}


def test_candidates_are_pruned_where_they_are_made(spark):
    """Of records with one pin code and a few common words, candidates are little more than the pairs that a zone keeps,
    each once before the last distinct; their records aren't written with them."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"{'abc'[i % 3]}{i:04d}", "abc"[i % 3], f"R{i}", "".join(r.sample("qwertyuiopasdfghjkl", 9)), "", "", "lane " + " ".join(r.sample(words, 3)), "1", "s", f"{i % 9 * 111111}", "") for i in range(150)]
    recs = prepared(spark.createDataFrame(rows, "ord string, source string, " + ", ".join(f"{f} string" for f in FIELDS))).persist()
    kept = scored(recs, theta(recs), Model(), prune=False).where("zone <> 'SEPARATE'").select("ord1", "ord2")
    found = blocked(recs, Model())
    assert set(map(tuple, kept.collect())) <= set(map(tuple, found.collect())) and found.count() <= kept.count() + 5


def test_scratch_leaves_no_shuffle_files(spark, tmp_path):
    made = lambda: set(Path(spark.conf.get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS") or "/tmp").glob("**/blockmgr-*/*/shuffle_*.data"))
    scratch, before = Scratch(spark, "t"), made()
    scratch.keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert made() <= before
