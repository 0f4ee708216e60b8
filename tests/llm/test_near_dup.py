"""Near-duplicate classes against all pairs."""

import random
import re

import numpy as np
import pytest

from folioscope.llm import bytes_np, graph, near_dup


def sets_of(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(docs, width, percent):
    ids = [i for i, _ in docs]
    sets = [sets_of(t, width) for _, t in docs]
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x in range(len(docs)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(ids[x]), find(ids[y])
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i), find(i) == i) for i, s in zip(ids, sets, strict=True)}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "é", "x y"]
    docs = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([3, 20, 120]))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
    docs += [None, "", "  \n", "one", "ONE", "one two", "É b c", "é b c", docs[0].upper(), docs[0].replace(" ", "\t\n")]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(i * 3 + 1, docs[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("width", "tiles"), [(2, 2000), (2, 0), (5, 2000)])
def test_classes_are_those_of_all_pairs(spark, width, tiles, monkeypatch):
    monkeypatch.setattr(near_dup, "PAIRS", tiles)
    monkeypatch.setattr(near_dup, "TILE_BYTES", 5000)
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, rep string, n double").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, width=width).collect()}
    assert got == brute(docs, width, 80)


def test_odd_rows(spark):
    df = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (7, "A B C"), (8, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df, width=2).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, None, True), (7, 5, False), (8, 8, True)], key=str)
    left = sorted((r.doc_id for r in near_dup.drop_near_duplicates(df, width=2).collect()), key=str)
    assert left == [5, 5, 8, None]
    assert near_dup.near_duplicates(df.limit(0)).collect() == []


def test_an_id_with_several_texts(spark):
    rows = [(1, "p q r s t u v w"), (2, "a b c d e f g h i j k l"), (2, "m n o p q r s t u v"), (3, "m n o p q r s t u v x"), (4, "a b c d e f g h i j k l z"), (5, "solo")]
    got = {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (4, 2), (5, 5)}


def test_signature_estimates_similarity():
    a, b = np.arange(0, 1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    x, y = near_dup.signature(bytes_np.mix(a)), near_dup.signature(bytes_np.mix(b))
    assert abs((x == y).mean() - 800 / 1200) < 0.12
    assert (near_dup.signature(bytes_np.mix(a)[::-1]) == x).all()


def test_closures_carry_no_tables():
    from pyspark import cloudpickle

    near_dup.signature(bytes_np.mix(np.arange(5, dtype=np.uint64)))  # the driver has used the tables itself
    assert near_dup._tables and all(len(cloudpickle.dumps(f)) < 100_000 for f in (near_dup._sign(5), near_dup._sets(5), near_dup._compare(80)))


def test_long_and_short_texts_hash_alike():
    texts = ["a b c", "x " * 1_200_000 + "y", "a b c", "", None, "a"]
    found = list(bytes_np.shingles(texts, 2))
    assert [len(f) for f in found] == [2, 2, 2, 0, 0, 1] and (found[0] == found[2]).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
