"""Benchmark decontamination by a prefix-filtered set join [native].

A window is ``size`` consecutive words of a benchmark item (all of them if it has
fewer). Containment of a window needs all its shingles (adjacent word pairs; the
word itself in a window of one word), so by the prefix principle its rarest
shingle suffices to find candidates. Rarity is counted over the whole corpus. A
document meets windows in an equi-join on that shingle; position and length
bounds discard impossible placements, and the words of the window are then
compared one by one at the place that is left.

Up to BLOCK windows are broadcast, and words never leave the task that read them:
shingles are generated, probed and confirmed in one stage, and only true
occurrences, and one row per document, are shuffled. Beyond that, documents are
written once, as words under row numbers, the shingles (row, place, hash) are shuffled to
the windows' ones, and what fits is confirmed in one more pass over the words; so
the corpus is read a fixed number of times, however large the benchmark.

Defined cases: a null or wordless text has no words and no hits; a null or
wordless item no windows; items without an id mark words as hit but are not
listed; items that repeat count once; each row of documents gives one row, also
where ids repeat or are null; a long text costs a task some thirty times its
bytes; other columns of the inputs are not looked at, also if they have the names
that are used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize, scratch, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z are lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows that are broadcast, of some 400 bytes each; more are shuffled.
BLOCK = 100_000
#: Shingles of windows that are broadcast to be counted, of 8 bytes each; more are shuffled.
BROADCAST_HASHES = 1_000_000
#: Ids broadcast at once, of 8 bytes each.
BROADCAST_IDS = 1_000_000
SENTINEL = -(2**63)


def words_of(text: Column) -> Column:
    """Only A-Z change case; lower() does just that where a text is all ASCII, and faster."""
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BETWEEN_WORDS), "")


def pairs_of(words: Column) -> Column:
    """Hashes of adjacent word pairs, at the place of the first word."""
    count = F.size(words)
    return F.when(count > 1, F.zip_with(F.slice(words, 1, count - 1), F.slice(words, 2, count - 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def singles_of(words: Column) -> Column:
    return F.transform(words, lambda a: F.xxhash64(a, F.lit(1)))


def windows_of(items: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """Distinct windows: words, their number, and the ids (as strings) of the items that have them."""
    w = items.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    w = w.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("at"))
    w = w.select("item", F.slice("w", F.col("at") + 1, F.least(F.size("w"), F.lit(size))).alias("window"))
    return w.groupBy("window").agg(F.collect_set("item").alias("items"))


def rarest_shingles(windows: DataFrame, docs: DataFrame, shingles: int, single: bool) -> DataFrame:
    """(hash, offset, len, window, items): of each window, the shingle that is rarest over the words w of docs."""
    own = windows.withColumn("hash", F.when(F.col("len") > 1, pairs_of(F.col("window"))).otherwise(singles_of(F.col("window"))))
    own = own.select("window", "items", "len", F.posexplode("hash").alias("offset", "hash"))
    asked = own.select("hash").distinct()
    seen = docs.select(F.explode(F.concat(pairs_of(F.col("w")), singles_of(F.col("w"))) if single else pairs_of(F.col("w"))).alias("hash"))
    if shingles <= BROADCAST_HASHES:
        counted = seen.join(F.broadcast(asked), "hash", "left_semi").groupBy("hash").count()
    else:
        counted = seen.groupBy("hash").count()
    rare = own.join(counted, "hash", "left").groupBy("window", "items", "len").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), F.col("offset"), F.col("hash"))).alias("rare"))
    return rare.select(F.col("rare.hash").alias("hash"), F.col("rare.offset").alias("offset"), "len", "window", "items")


def _span(start: Column) -> Column:
    return F.struct(start.alias("s"), (start + F.col("len")).alias("e"))


def _hits_broadcast(docs: DataFrame, first: DataFrame, probes: DataFrame) -> DataFrame:
    """(row, key, n, spans, items) of all rows: a mark that every row has keeps those without hits."""
    mark = docs.sparkSession.sql(f"select {SENTINEL + 1}L - 1L as hash, 0 as offset, 0 as len, cast(null as array<string>) as window, cast(null as array<string>) as items")
    start = F.when(F.col("at") > F.col("pairs"), F.col("at") - F.col("pairs") - 1).otherwise(F.col("at") - F.col("offset"))
    is_mark = (F.col("len") == 0) & (F.col("at") == F.col("pairs"))
    placed = (F.col("len") > 0) & (F.col("at") != F.col("pairs")) & (start >= 0) & (start + F.col("len") <= F.col("n"))
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("window")
    right = F.broadcast(mark.unionByName(first)).withColumnRenamed("hash", "asked")
    hits = probes.join(right, (F.col("hash") == F.col("asked")) & (is_mark | (placed & same)))
    hits = hits.select("row", "key", "n", F.when(F.col("len") > 0, _span(start)).alias("span"), "items")
    return hits.groupBy("row", "key").agg(F.max("n").alias("n"), F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))


def _hits_shuffled(docs: DataFrame, first: DataFrame, probes: DataFrame, root: str) -> DataFrame:
    """The same for many windows; docs have row numbers that were written."""
    start = F.when(F.col("at") > F.col("pairs"), F.col("at") - F.col("pairs") - 1).otherwise(F.col("at") - F.col("offset"))
    candidates = probes.where("at <> pairs").select("row", "n", "pairs", "at", "hash").join(first, "hash")
    candidates = candidates.select("row", "n", start.alias("start"), "len", "window", "items").where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
    candidates = materialize(candidates.select("row", "start", "len", "window", "items"), f"{root}/candidates")
    hits = candidates.join(docs.select("row", "w"), "row").where(F.slice("w", F.col("start") + 1, F.col("len")) == F.col("window"))
    hits = hits.select("row", _span(F.col("start")).alias("span"), "items").groupBy("row").agg(F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))
    return docs.select("row", "key", F.size("w").alias("n")).join(hits, "row", "left")


def find_contamination(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    root = scratch(documents.sparkSession, "decontaminate")
    windows = materialize(windows_of(items, item, item_text, size).withColumn("len", F.size("window")), f"{root}/windows")
    number, shingles, least = windows.agg(F.count("*"), F.sum(F.greatest(F.col("len") - 1, F.lit(1))), F.min("len")).first()
    single = least == 1
    # Beside the row number, which is not the same each time it is worked out, words are split once and not for every use.
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words_of(F.col(text)).alias("w"))
    many = number > BLOCK
    if many:  # rows are looked up again, so their numbers must stay
        docs = materialize(docs, f"{root}/documents")
    first = materialize(rarest_shingles(windows, docs, shingles or 0, single), f"{root}/first")
    probe = F.concat(pairs_of(F.col("w")), F.array(F.lit(SENTINEL).cast("bigint")), *([singles_of(F.col("w"))] if single else []))
    probes = docs.withColumn("probe", probe).select("row", "key", "w", F.size("w").alias("n"), F.greatest(F.size("w") - 1, F.lit(0)).alias("pairs"), F.posexplode("probe").alias("at", "hash"))
    hits = _hits_shuffled(docs, first, probes, root) if many else _hits_broadcast(docs, first, probes)

    found = F.coalesce(F.array_sort(F.array_distinct(F.flatten("items"))), F.array().cast("array<string>"))
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach"))
    covered = F.aggregate(F.array_sort(F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>"))), zero, lambda a, s: F.struct((a.hit + F.greatest(s.e - F.greatest(s.s, a.reach), F.lit(0))).alias("hit"), F.greatest(a.reach, s.e).alias("reach")))
    return hits.withColumn("items", found).withColumn("hit", covered.hit).select(
        F.col("key").alias(key),
        F.col("n").cast("long").alias("n_words"),
        F.col("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("hit") > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """documents without those that hold a window of an item; rows that share an id, or have none, go together."""
    lost = unused(documents, "lost")
    found = find_contamination(documents, items, key, **options).where("contaminated").select(F.col(key).alias(lost)).distinct()
    found = materialize(found, scratch(documents.sparkSession, "contaminated"))
    number, known = found.agg(F.count("*"), F.count(lost)).first()
    same = F.col(key) == F.col(lost) if number == known else F.col(key).eqNullSafe(F.col(lost))
    return documents.join(F.broadcast(found) if number <= BROADCAST_IDS else found, same, "left_anti")
