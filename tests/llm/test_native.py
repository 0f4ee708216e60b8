"""Sharding, decontamination and URL rules against plain Python."""

import hashlib
import random
import re

import pytest

from folioscope.llm import decontaminate, sharding, store, url_filter


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            n = min(size, len(iw))
            for s in range(len(iw) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[s : s + n]:
                        hit |= set(range(p, p + n))
                        found |= {str(item)} if item is not None else set()
        ids = sorted(found)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def test_contamination_is_that_of_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["a", "b", "É", "é", "c9", "Zed", "日本", "x"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 9, 10, 11, 14])))) for i in range(12)]
    items += [(99, None), (98, "?!"), (3, items[3][1]), (None, "solo einzig dos")]
    docs = [(i, "  ".join(rng.choices(vocabulary, k=rng.randrange(0, 40)))) for i in range(40)]
    docs += [(100, f"x, {items[5][1].upper()}; y"), (101, None), (102, ""), (102, items[1][1]), (None, "Solo EINZIG dos"), (7, docs[7][1]), (103, items[4][1] + " " + items[4][1])]
    d = spark.createDataFrame([(*r, "zz", 1) for r in docs], "doc_id long, text string, w string, row int").repartition(3)
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, hash int")
    got = [tuple(r) for r in decontaminate.find_contamination(d, b).collect()]
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)
    monkeypatch.setattr(decontaminate, "BLOCK", 7)  # more windows than are broadcast
    for most in (10**6, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", most)
        again = [tuple(r) for r in decontaminate.find_contamination(d, b).collect()]
        assert sorted(again, key=key) == sorted(got, key=key)
    kept = sorted((r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()), key=str)
    lost = {r[0] for r in got if r[5]}
    assert kept == sorted((r[0] for r in got if r[0] not in lost), key=str) and None in lost


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.find_contamination(d, b).collect() == [] and decontaminate.drop_contaminated(d, b).collect() == []
    long = spark.createDataFrame([(1, "x y " * 100_000 + "q " + "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "W1 w2, w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string")
    assert tuple(decontaminate.find_contamination(long, item).first())[:4] == (1, 200_011, 10, 1)
    assert tuple(decontaminate.find_contamination(one, b).first())[:4] == (1, 2, 0, 0)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("deep.example.org", "/es/x", "allow")]


def judge(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark, monkeypatch):
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.org/es/1", "http://a.example.org/es/x?y#z", "http://deep.example.org/es/xyz", "http://x.com/fr/1", "http://x.com/de/?q", "http://x.com/d", "http://notexample.org/es/", "http://example.org/en/12", "http://example.org", "ftp://a.b.c.org#f/", "http://x.org/é/ü", "http://x.com/fr/1", "http://../..", "http://a.com/" + "z" * 5000]
    pages = spark.createDataFrame([(i if i != 3 else None, u, "r", "h") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    rules = spark.createDataFrame([*RULES, ("x", None, "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, "page_id").collect()}
    assert got == {(i if i != 3 else None, *judge(u)) for i, u in enumerate(urls)}
    for digits in (8, 1, 0):  # short prefixes that collide: with 0 digits, all do
        monkeypatch.setattr(url_filter, "SHORT", digits)
        assert got == {tuple(r) for r in url_filter.judge_urls(pages, rules, "page_id").collect()}
    monkeypatch.setattr(url_filter, "SHORT", 8)
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    judged = url_filter.judge_urls(pages, rules, "page_id")
    assert got == {tuple(r) for r in judged.collect()}
    joins = [line for line in judged._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert joins and all("digest" not in line for line in joins)
    assert url_filter.judge_urls(pages, rules.limit(0), "page_id").where("rule is not null or verdict <> 'allow'").count() == 0
    assert url_filter.judge_urls(pages.limit(0), rules, "page_id").count() == 0


def test_shards_keep_every_row_and_merge_by_size(spark):
    root = store.scratch(spark, "t")
    s = sharding.ShardStore(spark, root, target_bytes=60_000, base_bytes=1000, fan_in=3)
    rows = [(i if i % 9 else None, None if i % 7 == 0 else "é" * (i % 50), "dup") for i in range(900)]
    for k in range(0, 900, 90):
        s.append(spark.createDataFrame(rows[k : k + 90], "path long, bytes string, version string").coalesce(2))
    before = s.manifest()
    assert len(before["shards"]) == 20 and s.read().count() == 900
    old = s.read(5).count()
    assert s.compact() >= 1 and old == 450
    after = s.manifest()
    assert len(after["shards"]) < 10 and not s.plan()
    assert sorted(map(repr, s.read().collect())) == sorted(map(repr, spark.createDataFrame(rows, "path long, bytes string, version string").collect()))
    assert s.read(5).count() == 450  # older versions stay readable until vacuumed
    lost = s._written(spark.createDataFrame(rows[:9], s.read().schema).coalesce(1))[0]["path"]  # of a writer that died
    s.files.write("manifests/.draft-dead", "{")
    assert s.vacuum() == 0 and s.read().count() == 900 and s.versions() == [after["version"] - 1, after["version"]]
    assert s.read(after["version"] - 1).count() == 900 and lost in dict(s.files.below("data"))
    assert s.vacuum(keep=1, left_over_hours=-1) > 0
    assert s.read().count() == 900 and s.versions() == [after["version"]]
    assert set(dict(s.files.below("data"))) - {x["path"] for x in after["shards"]} <= {p for p in dict(s.files.below("data")) if "/_" in p or "/." in p}
    assert not [p for p in dict(s.files.below("manifests")) if "draft" in p]
    again = sharding.ShardStore(spark, root)
    assert again.read().count() == 900
    again.append(spark.createDataFrame([], again.manifest() and s.read().schema))
    assert again.read().count() == 900


def test_one_of_two_writers_wins_a_version(spark):
    root = store.scratch(spark, "t")
    one, two = (sharding.ShardStore(spark, root, target_bytes=10**6, base_bytes=100, fan_in=2) for _ in range(2))
    df = spark.range(10).coalesce(1)
    base = one.manifest()
    one.append(df)
    two._commit(base, set(), two._written(df), df.schema)  # based on a version that is taken: goes on top
    assert two.read().count() == 20 and one.versions() == [1, 2]
    lost = {s["path"] for s in one.manifest()["shards"]}
    one.compact()
    with pytest.raises(sharding.CommitConflict):
        two._commit(two.manifest(), lost, [], df.schema)


def test_empty_store(spark):
    s = sharding.ingest(spark.createDataFrame([], "a long"), store.scratch(spark, "t"))
    assert s.read().collect() == [] and s.read().columns == ["a"]
    assert sharding.ShardStore(spark, store.scratch(spark, "t")).read().columns == []


def test_any_table_arrives_in_parts(spark):
    rows = [(k, "ü" * (k % 9), None) for k in range(500)] + [(1, "x", 2)] * 9
    df = spark.createDataFrame(rows, "a long, b string, c long").where("a <> 7").coalesce(1)
    s = sharding.ingest(df, store.scratch(spark, "t"), target_bytes=50_000, base_bytes=500, fan_in=3)
    assert s.manifest()["version"] > 8 and len(s.manifest()["shards"]) < 8  # eight arrivals, and merges
    assert sorted(map(repr, s.read().collect())) == sorted(map(repr, df.collect())) and not s.files.below("landing")
