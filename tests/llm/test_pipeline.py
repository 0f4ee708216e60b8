"""The pipeline's stages against plain rules, on a small fixture."""

import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
import test_native
import test_near_dup

import corpus_pipeline
from folioscope.llm import langid, lattice, pieces, quality, queries

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rng = random.Random(9)
    parts = {"xx": ["the", "ing", "and", "tion", "es"], "yy": ["ung", "sch", "der", "keit", "ü"]}
    make = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 5))) for _ in range(n))
    docs, labels = [], []
    for i in range(120):
        lang = "xx" if i % 2 else "yy"
        text = make(lang, rng.randrange(15, 60))
        good = i % 4 > 0
        docs.append((i, text if good else " ".join(w + "***" for w in text.split()), lang, "s", len(text)))
        labels.append((i, int(good), 0))
    item = make("xx", 14)
    near = docs[1][1] + " " + make("xx", 1)
    docs += [(200, near, "xx", "s", 0), (201, docs[2][1].upper(), "yy", "s", 0), (202, f"{make('xx', 9)} {item} {make('xx', 9)}", "xx", "s", 0), (203, "12 + 34", "xx", "s", 7), (204, None, "xx", "s", None)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs


def good(rows, folder, spark):
    """Ids that the plain model accepts: the mean of a text's feature weights."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    known = sorted((r.doc_id, r.text or "") for r in rows if r.doc_id in labels)
    model = quality.train([t for _, t in known], [labels[i] for i, _ in known])
    out = set()
    for r, feats in zip(rows, quality.features([r.text for r in rows]), strict=True):
        margin = model.bias + (sum(float(model.weight[f]) for f in feats) / len(feats) if len(feats) else 0)
        out |= {r.doc_id} if margin >= 0 else set()
    return out


def identified(rows):
    """Ids whose best language, by sums over all segmentations of each word, has a chance of a half."""
    texts = {}
    for r in rows:
        if r.lang is not None and r.text is not None:
            texts.setdefault(r.lang, []).append(r.text)
    model, out = langid.train(texts, pieces.model_path()), set()
    vocab = lattice.vocabulary(model.vocabulary)

    def probability(word, k):
        word = "▁" + word
        go = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - vocab.longest), j):
                piece = vocab.index.get(word[i:j])
                go[j] += go[i] * (model.p[piece, k] if piece is not None else langid.STRANGE if j == i + 1 else 0)
        return go[-1]

    for r in rows:
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        odds = np.zeros(len(model.languages))
        for w in words:
            p = np.array([probability(w, k) for k in range(len(odds))])
            odds += np.log((1 - langid.FOREIGN) * p + langid.FOREIGN * p.mean())
        odds = np.exp(odds - odds.max())
        out |= {r.doc_id} if words and odds.max() / odds.sum() >= corpus_pipeline.LEAST_LIKELY else set()
    return out


def test_every_stage_is_that_of_plain_rules(spark, fixture):
    """Each stage on what the one before it kept, against its rule worked out row by row."""
    folder, docs = fixture
    table, sizes = spark.read.parquet(f"{folder}/documents.parquet"), []
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = table.collect()
        pairs = [(r.doc_id, r.text) for r in rows]
        sizes.append(len(rows))
        table = stage(spark, table, folder)
        got = table.collect()
        if name == "quality_classifier":
            want = good(rows, folder, spark)
        elif name == "language_id":
            want = identified(rows)
        elif name == "minhash_near_dedup":
            want = {i for i, (_, _, kept) in test_near_dup.brute(pairs, 5, 80).items() if kept}
        elif name == "benchmark_decontamination":
            want = {r[0] for r in test_native.brute(pairs, items) if not r[5]}
        else:
            want = {r.doc_id for r in rows}
            own, text = pieces.Encoder(pieces.model_path()), dict(pairs)
            for r in got:
                assert r.round_trip and r.ids == r.n_best_ids[0] and r.n_best_crc32 == [zlib.crc32(np.array(i, "<u4")) for i in r.n_best_ids]
                assert all(own.decode(np.array(i)) == text[r.doc_id].encode() for i in r.n_best_ids)
        assert {r.doc_id for r in got} == want and len(got) == len(want), name
        if name != "sentencepiece":
            assert {tuple(r) for r in got} == {tuple(r) for r in rows if r.doc_id in want}
    assert all(a > b for a, b in zip(sizes[:-1], sizes[1:], strict=True)), sizes  # every stage has something to reject


def test_the_whole_pipeline(spark, fixture):
    folder, docs = fixture
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    bad, copies, leaks, wordless = set(range(0, 120, 4)), {200}, {202}, {203, 204}
    assert not set(got) & (bad | copies | leaks | wordless)
    assert set(range(1, 120)) - bad <= set(got)  # clean documents stay
    assert all(r.round_trip and len(r.ids) == r.n_pieces for r in got.values())


def test_stages_keep_the_columns_of_documents(spark, fixture):
    folder, _ = fixture
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        clashing = docs.selectExpr("*", "'a' as score", "'b' as predicted", "'c' as found", "1 as h", "2 as row", "3 as w", "4 as lost")
        assert stage(spark, clashing, folder).columns == clashing.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_every_operator_is_registered():
    assert {re.match(r"op(\d+)_", k)[1] for k in queries.QUERIES} == {str(n) for n in range(1, 11)}
