"""The registered queries as they are, on the smallest tables: against their SQL, or the rules of their contracts."""

import hashlib
import re
import zlib
from pathlib import Path

import pytest

from folioscope.llm import html_extract, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, str(DATA)).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    result = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in result.description]
    got = [tuple(repr(r[c]) for c in columns) for r in run(spark, name)]
    assert sorted(got) == sorted(tuple(map(repr, r)) for r in result.fetchall())


def test_html(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = run(spark, "op4_html_extraction")
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in got} == {k: (p.url, t := html_extract.main_text(p.html), len(t)) for k, p in pages.items()}
    plain = lambda h: re.sub(r"<[^>]*>", " ", h or "")
    assert all("\n\n" not in r.text and r.text == r.text.strip() and (r.text or not plain(pages[r.page_id].html).strip()) for r in got)


def part(doc, parts):
    return zlib.crc32(str(doc).encode()) % parts


def test_quality(spark, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = {r.doc_id: r for r in run(spark, "op5_quality_classifier")}
    assert set(got) == set(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (part(d, 3) == 1) for d, r in got.items())
    held = [(r.predicted, labels[d]) for d, r in got.items() if r.held_out and d in labels]
    assert held and sum(a == b for a, b in held) / len(held) > 0.8


def test_tokens(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, set()
    for doc in sorted(texts):
        ids = [*library.encode(texts[doc], add_special_tokens=False).ids, 2]
        want.add((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert {tuple(r) for r in run(spark, "op6_token_ids")} == want


def test_pieces(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op7_sentencepiece_nbest")}
    assert set(got) == set(texts)
    for r in got.values():
        assert r.round_trip and r.n_best_pieces[0] == r.n_pieces and r.n_best_crc32[0] == r.ids_crc32
        assert list(r.n_best_scores) == sorted(r.n_best_scores, reverse=True) and len(r.n_best_scores) == len(r.n_best_crc32) <= 4


def test_languages(spark, texts):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in run(spark, "op8_language_id")}
    assert set(got) == set(texts)
    for d, r in got.items():
        letters = any(c.isalpha() for c in texts[d])
        assert r.held_out == (part(d, 5) == 0) and 0 <= r.score <= 1 and (r.lang_pred != "und") == letters and (letters or r.score == 0)
    held = [r.lang_pred == langs[d] for d, r in got.items() if r.held_out and langs[d] is not None and r.lang_pred != "und"]
    assert held and sum(held) / len(held) > 0.9


def test_media(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op9_media_avi")}
    assert set(got) == set(texts)
    for d, r in got.items():
        raw = texts[d].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes > r.payload_bytes and len(r.media_sha256) == 64 and r.feature.startswith(f"frames={len(payload) // 576};")
    by_text = {}
    for d, r in got.items():
        assert by_text.setdefault(texts[d], tuple(r)[1:]) == tuple(r)[1:]
