"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard.

Signatures: a first permutation (sigma) scatters a document's shingles over a
universe of 2**22 places; a second one (pi) is used for every coordinate, shifted
circularly by one more place each time: coordinate k is the least
pi[(sigma(shingle) + k) mod D]. As pi is a table, the values of one shingle for
all coordinates lie next to each other. Coordinates are grouped into bands; rows
that agree in a band are candidates, and each link is confirmed on the full sets
of 64-bit shingle hashes. 48 bands of 6 miss a pair at the threshold 0.8 with a
chance of 5e-7, a closer pair more rarely still.

Links are what matters, not pairs: rows of equal sets are one class, named by its
least id, and only classes are compared. Inside a bucket, classes are compared
with its least class first (a pair per class, however large the bucket), then
with a few others of its largest component. Whatever is still in different components after that
is compared pair by pair, but for pairs inside one component, which cannot
change the result. So nothing is capped: a group of near copies costs pairs in
proportion to its size, and only what stays apart is compared exhaustively.

Defined cases: null and wordless texts have an empty set and link with nothing;
null ids form one-row classes with a null component; ids of another type than
integers raise a TypeError; rows that share an id are one document, linked where
any of its texts is; a long text costs a worker some twenty times its bytes;
other columns are not looked at.

Skew: a bucket with a large share of the rows meets its head in narrow rows of a
few numbers, which adaptive execution splits; sets are joined by class, and those
of a class that many others are compared with in as many copies as it has
thousands of partners.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import LongType

from . import bytes_np
from .graph import components, joined
from .store import FileStore, claim, integer_key, materialize, release, scratch, trim, tune

BANDS, ROWS, SEED = 48, 6, 20240229
UNIVERSE = 1 << 22
#: Ids broadcast at once to pick documents out, of 8 bytes each.
BROADCAST_IDS = 1_000_000
#: Random members of a bucket's largest component that the others are compared with before all are.
PIVOTS = 3
#: Pairs still apart in a bucket that are compared as rows; more are compared in tiles of bounded blocks of sets.
PAIRS, TILE_BYTES = 2000, 2 << 20
#: Pairs that meet one copy of a set.
SHARE = 1000
_tables: dict[int, np.ndarray] = {}


def _forget() -> None:
    """A function of the module, so that a worker runs it on its own memory and no closure carries the driver's."""
    _tables.clear()


def _pi(coordinates: int) -> np.ndarray:
    """Row p: the values of one shingle at place p for all coordinates. A view, not a copy."""
    if coordinates not in _tables:
        order = np.random.default_rng(SEED).permutation(UNIVERSE).astype(np.uint32)
        _tables[coordinates] = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:coordinates]]), coordinates)
    return _tables[coordinates]


def _sigma(hashes: np.ndarray) -> np.ndarray:
    """Folds hashes into the universe, then permutes it: odd factors and xor-shifts are bijections."""
    x = hashes & np.uint64(UNIVERSE - 1)
    for factor in (0x2C1B3C6D, 0x297A2D39):
        x = (x * np.uint64(factor)) & np.uint64(UNIVERSE - 1)
        x ^= x >> np.uint64(11)
    return x.astype(np.int64)


def signature(hashes: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    pi, places = _pi(coordinates), _sigma(hashes)
    least = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(places), 512):
        np.minimum(least, pi[places[k : k + 512]].min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        h = bytes_np.mix(h * bytes_np.BASE + parts[:, k])
    return h.view(np.int64)


def _sign(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("signatures", _forget)
        for batch in batches:
            ids, n, prints, keys = batch["id"].tolist(), [], [], []
            for s in bytes_np.shingles(batch["text"].tolist(), width):
                n.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(band_keys(signature(s)) if len(s) else None)
            yield pd.DataFrame({"id": pd.array(ids, dtype="Int64"), "n": n, "print": prints, "keys": keys})
            trim()

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "set": [s.tobytes() for s in bytes_np.shingles(batch["text"].tolist(), width)]})
            trim()

    return run


def common(a: bytes, b: bytes) -> int:
    """Size of the intersection of two sorted sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


@pandas_udf(LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def _of_size(percent: int):
    """The sizes alone allow a Jaccard similarity of percent / 100."""
    return 100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, path: str) -> DataFrame:
    """Those of the pairs (a, b, n, other_n), read twice, whose sets are similar, as (a, b)."""
    often = pairs.groupBy("b").count().where(F.col("count") > SHARE).select("b", F.ceil(F.col("count") / SHARE).cast("int").alias("copies"))
    often = small(materialize(often, f"{path}-often"))
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")).join(often, "b", "left")
    right = right.select("b", "set_b", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    dealt = pairs.join(often, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("copies")), F.lit(0)).cast("int").alias("copy"))
    both = dealt.join(right, ["b", "copy"]).join(left, "a")
    size = lambda c: F.octet_length(c) / 8  # noqa: E731  of the sets themselves: an id may have several
    compared = both.select("a", "b", (size("set_a") + size("set_b")).alias("sizes"), _common("set_a", "set_b").alias("c"))
    return compared.where(100 * F.col("c") >= percent * (F.col("sizes") - F.col("c"))).select("a", "b")


def _confirmed_once(pairs: DataFrame, sets: DataFrame, percent: int, path: str) -> DataFrame:
    """The links among pairs (rep, n, other, other_n) that may come several times, either way around."""
    swap = F.col("rep") > F.col("other")
    ways = [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("rep", "other", "a"), ("other", "rep", "b"), ("n", "other_n", "n"), ("other_n", "n", "other_n"))]
    once = materialize(pairs.where(_of_size(percent)).select(*ways).distinct(), path)
    return materialize(confirmed(once, sets, percent, path), f"{path}-links")


def _tiled(large: DataFrame, sets: DataFrame, percent: int, path: str) -> DataFrame:
    """Links that join different components of large buckets, as (a, b).

    Members go into blocks of bounded bytes, by the least head of their buckets, so
    that members that share buckets share blocks. A tile is a block of members
    outside a bucket's largest component, and a block of members of the same bucket.
    """
    own = materialize(large.groupBy("rep", "n", "comp").agg(F.min("other").alias("home"), F.collect_set("bucket").alias("keys"), F.collect_set(F.when(F.col("comp") != F.col("top"), F.col("bucket"))).alias("minor")), f"{path}/own")
    weight = own.groupBy("home").agg(F.ceil(F.sum(F.col("n") * 8) / F.lit(TILE_BYTES)).alias("wholes"), F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.size("minor") > 0, F.col("n") * 8).otherwise(0)) / F.lit(TILE_BYTES))).alias("minors"))
    own = own.join(weight, "home").select("rep", "n", "comp", "keys", "minor", F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("wholes"))).alias("w"), F.when(F.size("minor") > 0, F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("minors")))).alias("m"))
    own = materialize(own, f"{path}/blocks")
    named = own.join(sets, F.col("rep") == F.col("id")).select("rep", "n", "comp", "keys", "minor", "w", "m", "set")
    ours = own.where("m is not null").select("m", F.explode("minor").alias("bucket")).distinct()
    theirs = own.select("w", F.explode("keys").alias("bucket")).distinct()
    tiles = materialize(ours.join(theirs, "bucket").select("m", "w").distinct(), f"{path}/tiles")
    left = named.drop("w").join(tiles, "m").select("m", "w", "rep", "n", "comp", F.col("minor").alias("keys"), "set")
    right = named.drop("m").join(tiles, "w").select("m", "w", "rep", "n", "comp", "keys", "set")
    right = right.toDF(*right.columns)  # new names for the planner, as both sides come from one table
    return left.groupBy("m", "w").cogroup(right.groupBy("m", "w")).applyInPandas(_compare(percent), "a long, b long")


def _compare(percent: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        whole = [np.frombuffer(s, np.uint64) for s in right["set"]]
        known, place = np.unique(np.concatenate(whole), return_inverse=True)
        sizes = np.array([len(s) for s in whole])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        comps, reps = right["comp"].to_numpy(), right["rep"].to_numpy()
        at: dict[int, list[int]] = {}
        for i, keys in enumerate(right["keys"]):
            for k in keys:
                at.setdefault(int(k), []).append(i)
        marked, out = np.zeros(len(known), bool), []
        for rep, comp, keys, raw in zip(left["rep"], left["comp"], left["keys"], left["set"], strict=True):
            own = np.frombuffer(raw, np.uint64)
            asked = np.zeros(len(whole), bool)
            for k in keys:
                asked[at.get(int(k), [])] = True
            asked &= (comps != comp) & (100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own)))
            if not asked.any():
                continue
            found = np.searchsorted(known, own)
            found = found[found < len(known)]
            found = found[np.isin(known[found], own)]
            marked[found] = True
            both = np.add.reduceat(marked[place].astype(np.int64), starts)
            marked[found] = False
            linked = np.flatnonzero(asked & (100 * both >= percent * (sizes + len(own) - both)))
            _, first = np.unique(comps[linked], return_index=True)  # one link to each component
            out += [(rep, reps[i]) for i in linked[first]]
        del left, right, whole, known, place, marked
        trim()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept."""
    spark = documents.sparkSession
    integer_key(documents, key)
    tune(spark)
    root = scratch(spark, "near-dup")
    files = FileStore(spark, root)
    docs = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = materialize(docs.mapInPandas(_sign(width), "id long, n long, print binary, keys array<long>"), f"{root}/signed")

    # Classes of equal sets.
    classes = signed.where("n > 0 and id is not null").groupBy("print").agg(F.min("id").alias("rep"))
    classes = materialize(classes, f"{root}/classes")
    reps = signed.join(classes, "print").where("id = rep").dropDuplicates(["id", "print"])
    rows = materialize(reps.select("rep", "n", F.explode("keys").alias("bucket")), f"{root}/rows")
    shared = rows.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = materialize(rows.join(shared.select("bucket", "hub"), "bucket").select("bucket", "rep", "n", F.col("hub.rep").alias("other"), F.col("hub.n").alias("other_n")), f"{root}/members")
    files.delete(f"{root}/rows")
    release(spark)

    # Full sets of the classes that share a bucket.
    asked = materialize(members.select(F.col("rep").alias("id")).distinct(), f"{root}/asked")
    chosen = docs.join(small(asked), "id", "left_semi")
    if _repeats(signed):
        chosen = chosen.dropDuplicates(["id", "text"])
    sets = materialize(chosen.mapInPandas(_sets(width), "id long, set binary"), f"{root}/sets")

    # Each class with the least of the classes at the head of its buckets.
    first = members.where("other < rep").where(_of_size(percent)).groupBy("rep", "n").agg(F.min(F.struct("other", "other_n")).alias("o"))
    first = materialize(first.select(F.col("rep").alias("a"), F.col("o.other").alias("b"), "n", F.col("o.other_n").alias("other_n")), f"{root}/first")
    links = materialize(confirmed(first, sets, percent, f"{root}/first"), f"{root}/links-0")
    release(spark)
    roots = components(links, f"{root}/components")

    # Then with members of the largest component of each bucket, then with all that stay apart.
    here = members.select("bucket", "rep", "n", "other")
    for step in ("pivots", "rest"):
        named = here.join(roots, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "n", "other", F.coalesce("root", "rep").alias("comp"))
        parts = named.groupBy("bucket", "comp").agg(F.count("*").alias("size"), *[F.min(F.struct(F.xxhash64("rep", F.lit(i)), F.col("rep"), F.col("n"))).alias(f"p{i}") for i in range(PIVOTS)])
        split = parts.groupBy("bucket").agg(F.max(F.struct(F.col("size"), F.col("comp"), *[F.col(f"p{i}") for i in range(PIVOTS)])).alias("top"), F.sum("size").alias("size"), F.count("*").alias("parts")).where("parts > 1")
        if step == "pivots":
            apart = named.join(split, "bucket").where(F.col("comp") != F.col("top.comp"))
            apart = apart.select("rep", "n", F.explode(F.array(*[F.struct(F.col(f"top.p{i}.rep").alias("rep"), F.col(f"top.p{i}.n").alias("n")) for i in range(PIVOTS)])).alias("p"))
            more = _confirmed_once(apart.select("rep", "n", F.col("p.rep").alias("other"), F.col("p.n").alias("other_n")), sets, percent, f"{root}/{step}")
        else:
            apart = (F.col("size") - F.col("top.size")) * F.col("size")
            left = materialize(named.join(split.select("bucket", F.col("top.comp").alias("top"), (apart > PAIRS).alias("large")), "bucket"), f"{root}/left")
            few = left.where("not large")
            minor = few.where("comp <> top").select("bucket", "rep", "n", "comp")
            whole = few.select("bucket", F.col("rep").alias("other"), F.col("n").alias("other_n"), F.col("comp").alias("other_comp"))
            pairs = minor.join(whole, "bucket").where("comp <> other_comp").select("rep", "n", "other", "other_n")
            more = _confirmed_once(pairs, sets, percent, f"{root}/{step}")
            large = left.where("large")
            if not large.isEmpty():
                release(spark)
                more = more.unionByName(materialize(_tiled(large, sets, percent, root), f"{root}/tiled"))
        release(spark)
        if not more.isEmpty():
            roots = joined(roots, more, f"{root}/components-{step}")

    found = signed.join(classes, "print", "left").join(roots, F.col("rep") == F.col("node"), "left")
    group = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("root", "rep")).otherwise(F.col("id"))
    out = found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), group.alias("component_id"), F.coalesce(group == F.col("id"), F.lit(True)).alias("kept"))
    out = materialize(out, scratch(spark, "near-dup-found"))
    files.delete(root)
    release(spark)
    return out


def drop_near_duplicates(documents: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """documents with one row of each class: that of the least id. Rows without an id stay."""
    found = near_duplicates(documents, key, **options)
    lost = materialize(found.where("not kept").select(key).distinct(), scratch(documents.sparkSession, "near-dup-lost"))
    return documents.join(small(lost), key, "left_anti")


def small(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if it has few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _repeats(signed: DataFrame) -> bool:
    """Some id is on more than one row."""
    return bool(signed.groupBy("id").count().where("count > 1 and id is not null").limit(1).count())
