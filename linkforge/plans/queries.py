"""The engine's operators as queries over a feed that is derived from the test tables, each with SQL of its own.

The feed takes whole texts only where a query says so: a record's name and address are the first 120 characters of a
document, its other fields come from the id, the length and a digest of the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.files import Files
from linkforge.functions.identity import key_id
from linkforge.functions.text import normal_name, tokens, trim
from linkforge.operators.candidates import address_pairs, identifier_pairs, phone_pairs, prepared
from linkforge.operators.model import WEIGHTS, Model
from linkforge.operators.registry import registry_rows, review_items, reviewed_rows
from linkforge.operators.tiles import NAMES, compared, equal_tiles, every_tile, feature_rows, similar_names
from linkforge.plans import views
from linkforge.plans.batch import STATES, Status, cross_pairs, link
from linkforge.schemas import FEATURES, FIELDS
from linkforge.scratch import Scratch
from linkforge.sources import landing
from linkforge.sources.store import Store, json_array, json_lines, json_number, json_numbers, json_object, json_string, latest

#: Records out of documents, in SQL that both engines run.
FEED = """
SELECT source || chr(31) || lpad(cast(doc_id AS string), 19, '0') AS ord, source, 'D' || cast(doc_id AS string) AS recordId,
       replace(left(text, 40), chr(10), ' ') AS businessName,
       CASE WHEN doc_id % 2 = 0 THEN upper(left(md5(text), 10)) ELSE '' END AS pan,
       CASE WHEN doc_id % 3 = 0 THEN upper(substr(md5(text), 11, 15)) ELSE '' END AS gstin,
       replace(substr(text, 41, 80), chr(10), ' ') AS address, cast(560000 + n_chars % 97 AS string) AS pinCode, lang AS sector,
       lpad(cast(n_chars AS string), 10, '0') AS phone, '' AS registrationDate
FROM documents
"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FEED.replace("FROM documents", "FROM {documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Lines of feeds out of the same records, for both engines: quoted and unquoted fields, quotes amid a field, doubled ones,
#: open ones, blanks around fields, short and long rows.
LINES = f"""
SELECT source, doc_id, CASE doc_id % 5
  WHEN 0 THEN recordId || ',"' || replace(businessName, '"', '""') || '",' || pan || ',' || gstin || ', "' || address || '" ,' || pinCode || ',' || sector || ',' || phone || ',x,' || recordId || ',y'
  WHEN 1 THEN ' ' || recordId || ' ,' || businessName || ',' || pan || ',"' || gstin || '",a"b,c"d""e,' || pinCode
  WHEN 2 THEN recordId || ',"' || '""' || left(businessName, 9) || '"" Mills",' || pan || ',' || gstin || ',"open, ' || address
  WHEN 3 THEN recordId || ',,,,' || address || ',,,' || phone || ',,"",""'
  ELSE CASE WHEN doc_id % 2 = 0 THEN '' ELSE ',' || businessName || ',"' END END AS line
FROM (SELECT f.*, cast(substr(recordId, 2) AS bigint) AS doc_id FROM ({FEED}) f) g
"""


def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landing path: feeds are written as dept_<source>.csv, listed, found ready and read."""
    files, scratch = Files(spark), Scratch(spark, "landing")
    folder, parts = scratch.path("feeds"), scratch.path("parts")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = spark.sql(LINES.replace("FROM documents", "FROM {documents}"), documents=docs)
    head = docs.select("source").distinct().select("source", F.lit(-1).cast("long").alias("doc_id"), F.lit(",".join(FIELDS)).alias("line"))
    whole = lines.unionByName(head).repartition("source").sortWithinPartitions("source", "doc_id")
    whole.select(F.col("line").alias("value"), "source").write.partitionBy("source").text(parts)
    files.make(folder)
    for part in files.ls(parts):
        for f in files.ls(part.path) if "=" in part.name else ():
            files.rename(f.path, f"{folder}/dept_{part.name.partition('=')[2]}.csv")
    files.create(f"{folder}/{landing.MARKER}", "done")
    if not landing.ready(files, folder):
        return spark.createDataFrame([], "source string, " + ", ".join(f"{f} string" for f in FIELDS))
    return landing.read_feeds(spark, [f.path for f in landing.manifest(files, folder)]).drop("ord")


def ingest_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(F.col("address"))
    return feed(spark, sf_dir).select("recordId", normal_name(F.col("businessName")).alias("name"), trim(F.col("address")).alias("address"), F.array_join(F.array_sort(words), " ").alias("tokens"), F.size(words).cast("long").alias("n_tokens"))


def pair_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = feed(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    a, b = (n.select(F.col("source").alias(f"s{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    return a.join(b, F.col("s1") < F.col("s2")).select("s1", "s2", (F.col("n1") * F.col("n2")).alias("pairs"))


def identifier_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifier_pairs(prepared(feed(spark, sf_dir)))


def token_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cross-source pair, as the plain service compares them: its result grows with the square of the feed.
    similar_addresses is the form for large feeds."""
    return compared(every_tile(feature_rows(prepared(feed(spark, sf_dir))).select("ord", "source", "at", "e")), "jaccard")


def similar_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-source pairs whose addresses have a token Jaccard of 0.5 or more, found by the prefix filter."""
    return address_pairs(prepared(feed(spark, sf_dir)), 0.5).select("o1", "o2", F.round("jaccard", 9).alias("jaccard"))


def phone_near_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phone_pairs(prepared(feed(spark, sf_dir)))


def scored_pairs_cheap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pairs with equal pin codes. Blocks of records meet, so the pairs themselves are never shuffled."""
    recs = prepared(feed(spark, sf_dir)).where("z <> ''")
    return compared(equal_tiles(feature_rows(recs, F.col("z").alias("k")), "k"), "score", Model())


def scored_pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As scored_pairs_cheap, whose SQL asks for equal pin codes, but of every cross-source pair."""
    return compared(every_tile(feature_rows(prepared(feed(spark, sf_dir)))), "score", Model())


def jaro_winkler_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of distinct names: n1 is in an earlier source than n2 if its first source is before the last of n2."""
    known = prepared(feed(spark, sf_dir)).groupBy("n").agg(F.min("source").alias("lo"), F.max("source").alias("hi"))
    return similar_names(every_tile(known.where("lo is not null"), NAMES))


def linked(spark: SparkSession, sf_dir: str, reviews: bool = True):
    return link(feed(spark, sf_dir), Model(), Scratch(spark, "query"), reviews)


def zone_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cross-source pairs by zone. Those in SEPARATE are counted in closed form; their scores aren't computed."""
    found = linked(spark, sf_dir).pairs.groupBy("zone").agg(F.count("*").alias("pairs"), F.round(F.min("score"), 9).alias("lowest"), F.round(F.max("score"), 9).alias("highest"))
    n = feed(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    every = n.agg(((F.pow(F.sum("n"), F.lit(2)) - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("every"))
    rest = every.crossJoin(found.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("kept"))).select(F.lit("SEPARATE").alias("zone"), (F.col("every") - F.col("kept")).alias("pairs"), F.lit(None).cast("double").alias("lowest"), F.lit(None).cast("double").alias("highest"))  # a row by a row
    return found.unionByName(rest.where("pairs > 0"))


def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, sf_dir).pairs.where("zone = 'REVIEW'").select(F.col("ord1").alias("o1"), F.col("ord2").alias("o2"), F.round("score", 9).alias("score"), "evidence")


def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch tells at its end."""
    records = feed(spark, sf_dir)
    x = link(records, Model(), Scratch(spark, "query"))
    sizes = x.comps.groupBy("comp").count()
    told = sizes.agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("autoLinked"), F.count(F.when(F.col("count") == 1, 1)).alias("singletons"), F.count("*").alias("registrySize"))
    return told.select(F.lit(records.count()).cast("long").alias("totalRecords"), F.lit(cross_pairs(records)).cast("long").alias("pairsChecked"), "autoLinked", F.lit(x.pairs.where("zone = 'REVIEW'").count()).cast("long").alias("pendingReview"), "singletons", "registrySize")


def auto_link_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, sf_dir, reviews=False).comps.select("ord", F.col("comp").alias("cluster"))


def cluster_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).where("pan <> ''").select("recordId", key_id(F.col("pan")).alias("entity"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = linked(spark, sf_dir, reviews=False)
    return registry_rows(x.recs, x.comps, x.pairs, "b", "")


def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).select(F.col("key").alias("cluster"), F.col("ubid").alias("entity"), "businessName", F.size("records").cast("long").alias("members"), F.array_join("sources", ",").alias("sources"), "evidence", "autoLinked")


def registry_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.registry_lines(registry(spark, sf_dir))


def singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).where("not autoLinked").select(F.col("records")[0]["recordId"].alias("recordId"), "evidence")


def registry_tail_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail of a store with two batches, whose names sort the other way round than their commits. The later one is
    the feed's small part, so the tail reaches back into the other."""
    store, records = Store(spark, Scratch(spark, "store").path("store")), feed(spark, sf_dir)
    late = "substr(recordId, -1) = '7' and source >= 'src18'"
    for name, part in (("z-first", f"not ({late})"), ("a-second", late)):
        x = link(records.where(part), Model(), Scratch(spark, "query"), reviews=False)
        store.put("registry", name, registry_rows(x.recs, x.comps, x.pairs, name, ""))
        store.commit(name)
    return views.registry_tail(store.table("registry")).select(F.col("commit").alias("batch"), F.col("key").alias("cluster"), "businessName")


def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).where("autoLinked").select(F.col("key").alias("cluster"), "evidence")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_items(linked(spark, sf_dir).reviews(), "b", "")


def reviewed_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows of decisions on all items: a match for those whose first record has an even number."""
    decided = items(spark, sf_dir).withColumn("match", F.substring("record1.recordId", 2, 20).cast("long") % 2 == 0)
    rows = reviewed_rows(decided, "")
    return rows.select("key", F.col("ubid").alias("entity"), "businessName", F.array_join("sources", ",").alias("sources"), F.array_join(F.transform("records", lambda r: r["recordId"]), ",").alias("records"), "evidence", "autoLinked", "humanVerified", F.round("score", 4).alias("score"))


def queue_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "id string, decision string, note string, seq long")
    return views.queue_lines(latest(items(spark, sf_dir), none))


def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", F.round(F.col("score") * 100).cast("long").alias("percent"), views.score_band(F.col("score")).alias("band"))


def comparison_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.comparison(items(spark, sf_dir))


def feature_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.feature_bands(items(spark, sf_dir))


def weight_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.weight_bars(weight_table(spark))


def weight_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS.items()), "name string, weight double")


def most_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.most_weight(weight_table(spark))


def model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(views.model_json(Model()),)], "value string")


def status_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and progress of every state, over the counts of the orders table."""
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    told = [Status(x, f'Step "{x}"', "batch-1", 1700000000000 + i, {"totalRecords": n, "autoLinked": i}) for i, x in enumerate(STATES)]
    return spark.createDataFrame([(t.state, views.progress(t.state), views.status_json(t)) for t in told], "state string, progress long, value string")


def recent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return views.recent(e.select(F.col("event_id").alias("at"), F.concat_ws(" ", "event_type", "user_id").alias("message")))


def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every whole text with its HTML signs escaped."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(views.html_escape(F.coalesce("text", F.lit("")))).alias("digest"))


def feedback_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights after all labelled documents, in their order: the label decides, the features come from the id. The fold
    doesn't commute, so decisions (which people make) stream through the driver."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").orderBy("doc_id").toLocalIterator()
    model = Model().folded(({f: (r["doc_id"] * (i + 3) % 11) / 10 for i, (f, _) in enumerate(FEATURES)}, r["quality"] == 1) for r in rows)
    return spark.createDataFrame([(k, round(v, 9)) for k, v in model.weights.items()], "name string, weight double")


def decision_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items and decisions out of orders: an order's customer is the item, its status the decision."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("id"))
    made = o.where("o_orderstatus <> 'O'").select(F.col("o_custkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "MATCH").otherwise("NO_MATCH").alias("decision"), F.col("o_orderpriority").alias("note"), F.col("o_orderkey").alias("seq"))
    return found, made


def queue_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(*decision_log(spark, sf_dir)).select("id", "status", "decision", "reviewNote")


def pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue_latest(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", json_string(F.col("props"), "k").alias("k"), json_number(F.col("props"), "k").alias("number"))


def json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of numbers and a nested object out of lines that are made from events: bad numbers are left out, strings
    hold quotes and braces."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bad = F.when(F.col("event_id") % 3 == 0, F.lit('"x"')).otherwise(F.col("user_id").cast("string"))
    line = F.concat(F.lit('{"features":{"name":'), F.col("event_id").cast("string"), F.lit(',"phone":'), bad, F.lit('},"record1":{"note":"}\\"{","id":"'), F.col("event_id").cast("string"), F.lit('"}}'))
    features = json_numbers(line, "features")
    return e.select("event_id", F.size(features).cast("long").alias("n_features"), features["name"].alias("name"), features["phone"].alias("phone"), json_string(json_object(line, "record1"), "id").alias("id"), json_string(json_object(line, "record1"), "note").alias("note"))


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as one JSON array of objects."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    return json_array(json_lines(n).select("value", json_number(F.col("value"), "n_nationkey").alias("key")))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    ingest_csv, ingest_normalized, pair_counts_by_source, identifier_match_pairs, token_jaccard_pairs, similar_addresses, phone_near_match, scored_pairs_cheap, scored_pairs_all, jaro_winkler_names, zone_summary, review_pairs, batch_counts,
    auto_link_clusters, cluster_ids, registry_summary, registry_json, singletons, registry_tail_50, best_evidence, reviewed_registry, queue_json, comparison_view, score_bands, feature_bands, weight_bars, most_weight, model_json, status_json, recent_log,
    escaped_texts, feedback_fold, queue_latest, pending_count, json_extract, json_nested, json_rows,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
TOKENS = r"list_filter(list_distinct(regexp_split_to_array(lower({}), '[\s[:punct:]]+')), lambda x: x <> '')"
#: The word boundary of the JVM knows all letters; RE2's does not, so neighbours are spelled out and the step is done twice.
FILLER = r"regexp_replace({}, '(^|[^\p{{L}}\p{{N}}_])(pvt ltd|private limited|m/s|ltd|limited|llp|and|co)([^\p{{L}}\p{{N}}_]|$)', '\1 \3', 'g')"
NAME = "trim(regexp_replace(regexp_replace(" + FILLER.format(FILLER.format("lower(businessName)")) + r", '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"
PREPARED = f"f AS ({FEED}), r AS (SELECT *, {TRIM.format('address')} AS a, {TOKENS.format(TRIM.format('address'))} AS ts, {NAME} AS n FROM f)"
#: Every cross-source pair, and those with equal pin codes.
EVERY = PREPARED + ", p AS (SELECT x.ord AS o1, y.ord AS o2, x, y FROM r x JOIN r y ON x.source < y.source)"
PAIRS = PREPARED + ", p AS (SELECT x.ord AS o1, y.ord AS o2, x, y FROM r x JOIN r y ON x.pinCode = y.pinCode AND x.source < y.source)"
JACCARD = "CASE WHEN x.a = '' AND y.a = '' THEN 1.0 WHEN x.a = '' OR y.a = '' THEN 0.0 WHEN len(x.ts) = 0 AND len(y.ts) = 0 THEN 1.0 WHEN len(x.ts) = 0 OR len(y.ts) = 0 THEN 0.0 ELSE CAST(len(list_intersect(x.ts, y.ts)) AS DOUBLE) / (len(x.ts) + len(y.ts) - len(list_intersect(x.ts, y.ts))) END"
PHONE = "CASE WHEN x.phone <> '' AND y.phone <> '' AND levenshtein(x.phone, y.phone) <= 1 THEN 1.0 ELSE 0.0 END"
SAME = "x.source < y.source AND (x.pan <> '' AND x.pan = y.pan OR x.gstin <> '' AND x.gstin = y.gstin)"
#: Jaro-Winkler of s and t by a fold over the places of s: the state is what is left of t ('#' where it is taken), then
#: '|' and what was taken. Transpositions count half, without rounding, and the prefix bonus holds at every value.
FOLD = """list_reduce(list_transform(range(1, length(s) + 1), lambda i: CAST(i AS VARCHAR)), lambda z, i:
  CASE WHEN instr(substr(left(z, length(t)), greatest(CAST(i AS INTEGER) - reach, 1), greatest(least(length(t), CAST(i AS INTEGER) + reach) - greatest(CAST(i AS INTEGER) - reach, 1) + 1, 0)), substr(s, CAST(i AS INTEGER), 1)) = 0 THEN z
  ELSE left(z, greatest(CAST(i AS INTEGER) - reach, 1) + instr(substr(z, greatest(CAST(i AS INTEGER) - reach, 1)), substr(s, CAST(i AS INTEGER), 1)) - 2) || '#'
       || substr(z, greatest(CAST(i AS INTEGER) - reach, 1) + instr(substr(z, greatest(CAST(i AS INTEGER) - reach, 1)), substr(s, CAST(i AS INTEGER), 1))) || substr(s, CAST(i AS INTEGER), 1) END, t || '|')"""


def winkler(names: str) -> str:
    """CTEs that end in jw (s, t, similarity) for the table names (s, t)."""
    return f"""j1 AS (SELECT s, t, greatest(CAST(floor(greatest(length(s), length(t)) / 2.0) AS INTEGER) - 1, 0) AS reach FROM {names}),
j2 AS (SELECT s, t, CASE WHEN s = t OR s = '' OR t = '' THEN t || '|' ELSE {FOLD} END AS z FROM j1),
j3 AS (SELECT s, t, substr(z, length(t) + 2) AS l, array_to_string(list_transform(list_filter(range(1, length(t) + 1), lambda j: substr(z, j, 1) = '#'), lambda j: substr(t, j, 1)), '') AS r FROM j2),
j4 AS (SELECT s, t, CAST(length(l) AS DOUBLE) AS m, len(list_filter(range(1, length(l) + 1), lambda k: substr(l, k, 1) <> substr(r, k, 1))) / CAST(2 AS DOUBLE) AS w,
              CASE WHEN left(s, 1) <> left(t, 1) THEN 0 WHEN left(s, 2) <> left(t, 2) THEN 1 WHEN left(s, 3) <> left(t, 3) THEN 2 WHEN left(s, 4) <> left(t, 4) THEN 3 ELSE 4 END AS same FROM j3),
j5 AS (SELECT *, CASE WHEN m = 0 THEN CAST(0 AS DOUBLE) ELSE (m / length(s) + m / length(t) + (m - w) / m) / 3 END AS jaro FROM j4),
jw AS (SELECT s, t, CASE WHEN s = t THEN CAST(1 AS DOUBLE) WHEN m = 0 THEN CAST(0 AS DOUBLE) ELSE jaro + least(same, length(s), length(t)) * CAST(0.1 AS DOUBLE) * (1 - jaro) END AS similarity FROM j5)"""


SAME_SECTOR = "CASE WHEN x.sector <> '' AND lower(x.sector) = lower(y.sector) THEN 1 ELSE 0 END"
SAME_PIN = "CASE WHEN x.pinCode <> '' AND x.pinCode = y.pinCode THEN 1 ELSE 0 END"
PAN, GSTIN = ("CASE WHEN x.{0} <> '' AND x.{0} = y.{0} THEN 1 ELSE 0 END".format(c) for c in ("pan", "gstin"))
D = "CAST({} AS DOUBLE)".format
UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-3' || substr({0}, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST('0x' || substr({0}, 17, 1) AS INTEGER) + 1, 1) || substr({0}, 18, 3) || '-' || substr({0}, 21, 12)".format
#: A number with two decimals as the JVM prints it: halves of its decimal form go up.
TWO = "printf('%.2f', CAST(round(CAST({} AS DECIMAL(18, 12)), 2) AS DOUBLE))".format
FOUR = "CAST(round(CAST({} AS DECIMAL(18, 12)), 4) AS DOUBLE)".format
#: Every cross-source pair with all features, score, zone and evidence; names are compared where they can matter.
SCORED = f"""{EVERY},
g AS (SELECT o1, o2, x, y, {PAN} AS pan_m, {GSTIN} AS gstin_m, greatest({PAN}, {GSTIN}) AS ident, {D(JACCARD)} AS address, {SAME_PIN} AS pin, {SAME_SECTOR} AS sector, {PHONE} AS phone FROM p),
h AS (SELECT * FROM g WHERE ident = 1 OR {D(0.3)} + {D(0.15)} * address + {D(0.1)} * pin + {D(0.05)} * sector + {D(0.05)} * phone >= {D(0.499999)}),
nn AS (SELECT DISTINCT x.n AS s, y.n AS t FROM h), {winkler("nn")},
k AS (SELECT h.*, similarity AS name, {D(0.35)} * ident + {D(0.3)} * similarity + {D(0.15)} * address + {D(0.1)} * pin + {D(0.05)} * sector + {D(0.05)} * phone AS weighted FROM h JOIN jw ON s = x.n AND t = y.n),
v AS (SELECT *, CASE WHEN ident = 1 THEN greatest({D(0.92)}, weighted) ELSE weighted END AS score,
             'Name: ' || {TWO("name")} || CASE WHEN pan_m = 1 THEN ', PAN: match' ELSE '' END || CASE WHEN gstin_m = 1 THEN ', GSTIN: match' ELSE '' END || ', Address: ' || {TWO("address")}
             || CASE WHEN pin = 1 THEN ', PinCode: match' ELSE '' END || CASE WHEN sector = 1 THEN ', Sector: match' ELSE '' END || CASE WHEN phone = 1 THEN ', Phone: match' ELSE '' END AS evidence FROM k),
z AS (SELECT *, CASE WHEN score >= 0.85 THEN 'AUTO_LINK' WHEN score >= 0.5 THEN 'REVIEW' ELSE 'SEPARATE' END AS zone FROM v)"""
#: Review items: ids, both records, numbers with four decimals.
ITEMS = f"""{SCORED},
q AS (SELECT md5('review:b' || chr(31) || o1 || chr(31) || o2) AS h, x, y, {FOUR("score")} AS score, evidence, {FOUR("ident")} AS identifier, {FOUR("name")} AS name, {FOUR("address")} AS address, {FOUR("pin")} AS pin, {FOUR("sector")} AS sector, {FOUR("phone")} AS phone FROM z WHERE zone = 'REVIEW'),
i AS (SELECT *, {UUID("h")} AS id FROM q)"""
#: Components of equal identifiers across sources, which are the automatic links at the initial weights.
CLUSTERS = f"""
WITH RECURSIVE f AS ({FEED}),
e AS (SELECT x.ord AS a, y.ord AS b FROM f x JOIN f y ON x.source <> y.source AND (x.pan <> '' AND x.pan = y.pan OR x.gstin <> '' AND x.gstin = y.gstin)),
w AS (SELECT ord AS v, ord AS u FROM f UNION SELECT w.v, e.b FROM w JOIN e ON w.u = e.a),
c AS (SELECT v AS ord, min(u) AS cluster FROM w GROUP BY v)
"""
REGISTRY_SQL = f"""
{CLUSTERS}, {SCORED.partition(", r AS")[0].replace(f"f AS ({FEED})", "ff AS (SELECT 1)")}{SCORED.partition(", r AS")[1]}{SCORED.partition(", r AS")[2]},
best AS (SELECT cluster, arg_min(evidence, (-score, o1, o2)) AS evidence FROM z JOIN c ON c.ord = o1 WHERE zone = 'AUTO_LINK' GROUP BY cluster),
m AS (SELECT cluster, count(*) AS members, list(f ORDER BY ord) AS ms FROM c JOIN f USING (ord) GROUP BY cluster),
one AS (SELECT m.*, best.evidence AS why, list_filter(list_transform(ms, lambda x: x.businessName), lambda x: trim(x) <> '') AS names, list_filter(list_transform(ms, lambda x: x.pan), lambda x: x <> '') AS pans,
        list_filter(list_transform(ms, lambda x: x.gstin), lambda x: x <> '') AS gstins, list_transform(ms, lambda x: x.source) AS srcs FROM m LEFT JOIN best USING (cluster)),
keyed AS (SELECT *, md5(CASE WHEN len(pans) > 0 THEN 'UBID:' || upper(pans[1]) WHEN len(gstins) > 0 THEN 'UBID:' || upper(gstins[1]) ELSE 'b:' || cluster END) AS h FROM one),
reg AS (SELECT cluster, {UUID("h")} AS entity, coalesce(names[1], 'Unknown') AS businessName, members, ms, list_filter(srcs, lambda x, i: list_position(srcs, x) = i) AS sources,
        CASE WHEN members > 1 THEN coalesce(why, '') ELSE 'No matching records found' END AS evidence, members > 1 AS autoLinked FROM keyed)
"""
RECORD = "json_object(" + ", ".join(f"'{f}', {{0}}.{f}" for f in FIELDS) + ", 'source', {0}.source)"


def oracle_sql() -> dict[str, str]:
    latest = "WITH d AS (SELECT CAST(o_custkey AS VARCHAR) AS id, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'MATCH' ELSE 'NO_MATCH' END, o_orderkey) AS decision, arg_max(o_orderpriority, o_orderkey) AS note FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_custkey), q AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN d.id IS NULL THEN 'PENDING' ELSE 'REVIEWED' END AS status, decision, note AS reviewNote FROM customer LEFT JOIN d ON d.id = CAST(c_custkey AS VARCHAR)) "
    bars = ", ".join(f"('{k}', CAST({v!r} AS DOUBLE))" for k, v in WEIGHTS.items())
    cheap = f"{D(0.15)} * {JACCARD} + {D(0.1)} * {SAME_PIN} + {D(0.05)} * {SAME_SECTOR} + {D(0.05)} * {PHONE}"
    ident = f"{D(0.35)} * CASE WHEN {SAME} THEN 1 ELSE 0 END"
    field = r',((?:[^",]|"(?:[^"]|"")*(?:"|$))*)'
    cell = lambda i: f"coalesce({TRIM.format(f'f[{i + 1}]')}, '')"
    trimmed = TRIM.format("line")
    unquote = f"""list_transform(regexp_extract_all(',' || {trimmed}, '{field}', 1), lambda x: replace(regexp_replace(x, '"((?:[^"]|"")*)(?:"|$)', '\\1', 'g'), '""', '"'))"""
    late = "substr(recordId, -1) = '7' AND source >= 'src18'"
    parts = f"WITH RECURSIVE f AS (SELECT *, CASE WHEN {late} THEN 2 ELSE 1 END AS batch FROM ({FEED}) x), e AS (SELECT x.ord AS a, y.ord AS b FROM f x JOIN f y ON x.batch = y.batch AND x.source <> y.source AND (x.pan <> '' AND x.pan = y.pan OR x.gstin <> '' AND x.gstin = y.gstin)), w AS (SELECT ord AS v, ord AS u FROM f UNION SELECT w.v, e.b FROM w JOIN e ON w.u = e.a), c AS (SELECT v AS ord, min(u) AS cluster FROM w GROUP BY v)"
    names = f"WITH {PREPARED}, u AS (SELECT n, min(source) AS lo, max(source) AS hi FROM r GROUP BY n), nn AS (SELECT a.n AS s, b.n AS t FROM u a JOIN u b ON a.lo < b.hi), {winkler('nn')}"
    cells = " UNION ALL ".join(f"SELECT id, '{f}' AS field, coalesce(x.{f}, '') AS v1, coalesce(y.{f}, '') AS v2 FROM i" for f in views.COMPARED)
    values = " UNION ALL ".join(f"SELECT id, '{f}' AS feature, {c} AS value FROM i" for f, c in (("identifier", "identifier"), ("name", "name"), ("address", "address"), ("pinCode", "pin"), ("sector", "sector"), ("phone", "phone")))
    grown = [f"least(0.6, greatest(0.01, w{i} + 0.02 * (CASE WHEN quality = 1 THEN f{i} ELSE 1 - f{i} END - 0.5)))" for i in range(1, 6)]
    fold = f"""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, quality, {", ".join(f"{D(f'(doc_id * {i + 3} % 11)')} / 10 AS f{i}" for i in range(1, 6))} FROM labels),
    s AS (SELECT CAST(0 AS BIGINT) AS k, {", ".join(f"{D(v)} AS w{i}" for i, v in enumerate(WEIGHTS.values()))} UNION ALL
          SELECT k, w0 / total, {", ".join(f"g{i} / total" for i in range(1, 6))} FROM (SELECT *, w0 + {" + ".join(f"g{i}" for i in range(1, 6))} AS total FROM (SELECT d.k, w0, {", ".join(f"{g} AS g{i}" for i, g in enumerate(grown, 1))} FROM s JOIN d ON d.k = s.k + 1))),
    l AS (SELECT * FROM s ORDER BY k DESC LIMIT 1)"""
    states = ", ".join(f"('{x}', {max(0, i - 1)}, {i})" for i, x in enumerate(STATES))
    json4 = lambda c: f"printf('%.4f', {c})"
    item = f"""'{{"id":"' || id || '","record1":' || {RECORD.format("x")} || ',"record2":' || {RECORD.format("y")} || ',"score":' || {json4("score")} || ',"features":{{"identifier":' || {json4("identifier")} || ',"name":' || {json4("name")} || ',"address":' || {json4("address")} || ',"pinCode":' || {json4("pin")} || ',"sector":' || {json4("sector")} || ',"phone":' || {json4("phone")} || '}},"evidence":"' || evidence || '","status":"PENDING","decision":null,"reviewNote":null,"createdAt":""}}'"""
    pan = lambda r: f"CASE WHEN {r}.pan <> '' THEN 'UBID:' || upper({r}.pan) END"
    match = "CAST(substr(x.recordId, 2) AS BIGINT) % 2 = 0"
    reviewed = f"""WITH {ITEMS}, a AS (SELECT id AS key, md5(coalesce({pan("x")}, {pan("y")}, 'review:' || id)) AS u, x.businessName AS businessName, x.source || ',' || y.source AS sources, x.recordId || ',' || y.recordId AS records, evidence, score FROM i WHERE {match}
    UNION ALL SELECT id || '/record1', md5(coalesce({pan("x")}, 'review:' || id || ':record1')), x.businessName, x.source, x.recordId, 'Human reviewer: not same business', NULL FROM i WHERE NOT ({match})
    UNION ALL SELECT id || '/record2', md5(coalesce({pan("y")}, 'review:' || id || ':record2')), y.businessName, y.source, y.recordId, 'Human reviewer: not same business', NULL FROM i WHERE NOT ({match}))
    SELECT key, {UUID("u")} AS entity, businessName, sources, records, evidence, false AS autoLinked, true AS humanVerified, round(score, 4) AS score FROM a"""
    return {
        "ingest_csv": f"WITH l AS ({LINES}), c AS (SELECT source, {unquote} AS f FROM l WHERE {trimmed} <> '') SELECT source, {', '.join(f'{cell(i)} AS {n}' for i, n in zip([*range(8), 9], FIELDS, strict=True))} FROM c",
        "ingest_normalized": f"WITH {PREPARED} SELECT recordId, n AS name, a AS address, array_to_string(list_sort(ts), ' ') AS tokens, CAST(len(ts) AS BIGINT) AS n_tokens FROM r",
        "pair_counts_by_source": f"WITH f AS ({FEED}) SELECT x.source AS s1, y.source AS s2, count(*) AS pairs FROM f x JOIN f y ON x.source < y.source GROUP BY ALL",
        "identifier_match_pairs": f"WITH f AS ({FEED}) SELECT x.ord AS o1, y.ord AS o2 FROM f x JOIN f y ON {SAME}",
        "token_jaccard_pairs": f"WITH {EVERY} SELECT o1, o2, round({JACCARD}, 9) AS jaccard FROM p",
        "similar_addresses": f"WITH {EVERY} SELECT o1, o2, round({JACCARD}, 9) AS jaccard FROM p WHERE len(x.ts) > 0 AND len(y.ts) > 0 AND {JACCARD} >= 0.5",
        "phone_near_match": f"WITH {EVERY} SELECT o1, o2 FROM p WHERE {PHONE} = 1",
        "scored_pairs_cheap": f"WITH {PAIRS} SELECT o1, o2, round({ident} + {cheap}, 9) AS score FROM p",
        "scored_pairs_all": f"WITH {EVERY} SELECT o1, o2, round({ident} + {cheap}, 9) AS score FROM p",
        "jaro_winkler_names": f"{names} SELECT s AS n1, t AS n2, round(similarity, 9) AS similarity FROM jw",
        "zone_summary": f"WITH {SCORED}, q AS (SELECT zone, count(*) AS pairs, round(min(score), 9) AS lowest, round(max(score), 9) AS highest FROM z WHERE zone <> 'SEPARATE' GROUP BY zone) SELECT * FROM q UNION ALL SELECT 'SEPARATE', CAST((SELECT count(*) FROM p) - coalesce((SELECT sum(pairs) FROM q), 0) AS BIGINT), NULL, NULL",
        "review_pairs": f"WITH {SCORED} SELECT o1, o2, round(score, 9) AS score, evidence FROM z WHERE zone = 'REVIEW'",
        "batch_counts": f"{CLUSTERS}, n AS (SELECT cluster, count(*) AS n FROM c GROUP BY cluster), {SCORED.replace(f'f AS ({FEED}), ', '', 1)} SELECT (SELECT count(*) FROM f) AS totalRecords, (SELECT count(*) FROM p) AS pairsChecked, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS autoLinked, (SELECT count(*) FROM z WHERE zone = 'REVIEW') AS pendingReview, count(*) FILTER (n = 1) AS singletons, count(*) AS registrySize FROM n",
        "auto_link_clusters": CLUSTERS + "SELECT ord, cluster FROM c",
        "cluster_ids": f"WITH f AS ({FEED}), k AS (SELECT recordId, md5('UBID:' || upper(pan)) AS h FROM f WHERE pan <> '') SELECT recordId, {UUID('h')} AS entity FROM k",
        "registry_summary": REGISTRY_SQL + "SELECT cluster, entity, businessName, members, array_to_string(sources, ',') AS sources, evidence, autoLinked FROM reg",
        "registry_json": REGISTRY_SQL + f"""SELECT '{{"ubid":"' || entity || '","businessName":' || to_json(businessName) || ',"sources":' || to_json(sources) || ',"records":[' || array_to_string(list_transform(ms, lambda x: CAST({RECORD.format("x")} AS VARCHAR)), ',') || '],"evidence":"' || evidence || '","linkedAt":"","autoLinked":' || autoLinked || '}}' AS value FROM reg""",
        "singletons": REGISTRY_SQL + "SELECT ms[1].recordId AS recordId, evidence FROM reg WHERE NOT autoLinked",
        "registry_tail_50": parts + ", m AS (SELECT batch, cluster, coalesce(arg_min(businessName, ord) FILTER (trim(businessName) <> ''), 'Unknown') AS businessName FROM c JOIN f USING (ord) GROUP BY batch, cluster) SELECT CAST(batch AS BIGINT) AS batch, cluster, businessName FROM m ORDER BY batch DESC, cluster DESC LIMIT 50",
        "best_evidence": REGISTRY_SQL + "SELECT cluster, evidence FROM reg WHERE autoLinked",
        "reviewed_registry": reviewed,
        "queue_json": f"WITH {ITEMS} SELECT {item} AS value FROM i",
        "comparison_view": f"WITH {ITEMS}, w AS ({cells}) SELECT *, v1 <> '' AND v2 <> '' AND lower(v1) = lower(v2) AS match, v1 <> '' AND v2 <> '' AND lower(v1) <> lower(v2) AS differ FROM w",
        "score_bands": f"WITH {ITEMS} SELECT id, CAST(round(score * 100) AS BIGINT) AS percent, CASE WHEN round(score * 100) >= 75 THEN 'high' ELSE 'medium' END AS band FROM i",
        "feature_bands": f"WITH {ITEMS}, w AS ({values}) SELECT *, CASE WHEN value >= 0.7 THEN 'green' WHEN value >= 0.5 THEN 'yellow' ELSE 'red' END AS band FROM w",
        "weight_bars": f"SELECT name, CAST(round(weight * 100) AS BIGINT) AS percent, CAST(least(round(weight / 0.6 * 100), 100) AS BIGINT) AS width FROM (VALUES {bars}) t(name, weight)",
        "most_weight": f"SELECT greatest(max(weight), 0.01) AS weight FROM (VALUES {bars}) t(name, weight)",
        "model_json": """SELECT '{"weights": {"pan": 0.35, "name": 0.3, "address": 0.15, "pinCode": 0.1, "sector": 0.05, "phone": 0.05}, "autoLinkThreshold": 0.85, "reviewThreshold": 0.5, "feedbackCount": 0}' AS value""",
        "status_json": f"""SELECT state, CAST(progress AS BIGINT) AS progress, '{{"state":"' || state || '","step":"Step ' || chr(39) || state || chr(39) || '","batchId":"batch-1","lastUpdated":' || (1700000000000 + i) || ',"stats":{{"totalRecords":' || (SELECT count(*) FROM orders) || ',"autoLinked":' || i || ',"pendingReview":0,"registrySize":0}}}}' AS value FROM (VALUES {states}) t(state, progress, i)""",
        "recent_log": "SELECT event_id AS at, event_type || ' ' || user_id AS message FROM events ORDER BY event_id DESC LIMIT 20",
        "escaped_texts": "SELECT doc_id, md5(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM documents",
        "feedback_fold": fold + " " + " UNION ALL ".join(f"SELECT '{k}' AS name, round(w{i}, 9) AS weight FROM l" for i, k in enumerate(WEIGHTS)),
        "queue_latest": latest + "SELECT id, status, decision, reviewNote FROM q",
        "pending_count": latest + "SELECT status, count(*) AS n FROM q GROUP BY status",
        "json_extract": "SELECT event_id, props ->> '$.k' AS k, coalesce(try_cast(props ->> '$.k' AS DOUBLE), 0.0) AS number FROM events",
        "json_nested": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS n_features, CAST(event_id AS DOUBLE) AS name, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS DOUBLE) END AS phone, CAST(event_id AS VARCHAR) AS id, '}\"{' AS note FROM events",
        "json_rows": """SELECT '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS value FROM nation""",
    }
