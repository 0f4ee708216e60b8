"""Extraction, classifiers, tokens, pieces and media against brute force, round trips and held-out rows."""

import hashlib
import itertools
import os
import random
import time
import zlib

import numpy as np
import pytest

from folioscope.llm import html_extract, langid, lattice, media_avi, near_dup, pieces, quality, token_store

TEXTS = [None, "", " ", "\n", "a", "Hello  world\n\n é 😀 ▁x", "日本 語\t" * 7, "x" * 5000, "tail \n", "\u0000\u0001", "ﬁ ß İ", "Hello  world\n\n é 😀 ▁x"]


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i if i != 4 else None, t, "q", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double").repartition(2)


# -- html -------------------------------------------------------------------


def page(body, head=""):
    return f"<html><head><title>T</title>{head}</head><body>{body}</body></html>"


LONG = "This is a sentence of the article, and it goes on for a while; then it ends."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<div>", ""),
        ("just text", "just text"),
        (page(f"<nav><a href=/>Home</a></nav><article><h1>Head &amp; more</h1><p>{LONG}<p>Short.<p>{LONG}</article><footer>(c) x</footer>"), f"Head & more\n{LONG}\nShort.\n{LONG}"),
        (page(f"<div class='cookie notice'><p>{LONG}</p></div><div id=main><p>{LONG}</p><p>b&#39;s  &lt;i&gt;</p><form><p>{LONG}</p></form></div><div class=sidebar><p>{LONG}</p></div>"), f"{LONG}\nb's <i>"),
        (page(f"<article><p>{LONG}</p><script>var a='<p>x</p>';</script><!-- <p>no</p> --><style>p{{}}</style><p>{LONG}</p></article><section id=comments><p>{LONG}</p></section>"), f"{LONG}\n{LONG}"),
        (page(f"<article><p><b>One{LONG}<br><p>{LONG}</p></article><aside>{LONG}</aside>")[:-30], f"One{LONG}\n{LONG}"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


MUCH = " ".join([LONG] * 12)


@pytest.mark.parametrize(
    "body",
    [
        f"<article><h1>Title</h1><p>Lead</p><div class=body><p>{MUCH}</p><p>{MUCH}</p></div><p>End</p></article>",
        f"<main><h1>Title</h1><p>Lead</p><div><div class=body><p>{MUCH}</p></div><p>{MUCH}</p></div><p>End</p></main>",
        f"<div><h1>Title</h1><p>Lead</p><div class=body><p>{MUCH}</p><p>{MUCH}</p></div><p>End</p></div>",
        f"<h1>Title</h1><p>Lead</p><p>{MUCH}</p><p>{MUCH}</p><p>End</p>",
        *[f"<div><h1>Title</h1><p>Lead</p><{t}>{MUCH}</{t}><{t}>{MUCH}</{t}><p>End</p></div>" for t in ("section", "blockquote", "pre", "p")],
        *[f"<{t}><h1>Title</h1><p>Lead</p><section><p>{MUCH}</p><p>{MUCH}</p></section><p>End</p></{t}>" for t in ("article", "div", "body")],
        f"<article><h1>Title</h1><p>Lead</p><ul><li>{MUCH}<li>{MUCH}</ul><p>End</p></article>",
        f"<div><h1>Title</h1><p>Lead</p><table><tr><td>{MUCH}<td>{MUCH}</table><p>End</p></div>",
    ],
)
def test_the_whole_article_is_kept(body):
    assert html_extract.main_text(page(body)) == f"Title\nLead\n{MUCH}\n{MUCH}\nEnd"


def test_articles_in_body():
    links = "<ul><li><a href='/a'>Home</a><li><a href='/b'>More</a></ul>"
    two = f"<article><h2>One</h2><p>{MUCH}</p></article><article><h2>Two</h2><p>{MUCH}</p><p>End</p></article>"
    assert html_extract.main_text(page(links + two + links)) == f"One\n{MUCH}\nTwo\n{MUCH}\nEnd"
    assert html_extract.main_text(page(f"<div><p>Hint</p></div><article><h1>One</h1><div><p>{MUCH}</p></div></article>")) == f"One\n{MUCH}"


@pytest.mark.parametrize("name", ["content no-sidebar", "has-sidebar", "with-ads", "widget-content", "comments-open", "search", "page header"])
def test_names_of_classes_do_not_lose_the_article(name):
    whole = f"<h1>Title</h1><p>Lead</p><p>{MUCH}</p><p>{MUCH}</p><p>End</p>"
    text = f"Title\nLead\n{MUCH}\n{MUCH}\nEnd"
    for body in (f"<div class='{name}'>{whole}</div>", f"<div id='{name.split()[-1]}'><article>{whole}</article></div>", f"<article><div class='{name}'>{whole}</div></article>", f"<article>{whole.replace('<h1', f'<h1 class=post-{name.split()[0]}')}</article>"):
        assert html_extract.main_text(page(body)) == text
        assert html_extract.main_text(page(f"<nav>Home</nav>{body}<div class='cookie'>{LONG}</div><div class='site-footer'>{LONG}</div>")) == text


def test_what_is_set_apart_is_read_where_nothing_else_is():
    assert html_extract.main_text(page(f"<div class=search><p>{LONG}</p></div><div class=widget><p>{LONG}</p></div>")) == f"{LONG}\n{LONG}"
    assert html_extract.main_text(page(f"<form><p>{LONG}</p></form><p hidden>x</p>")) == LONG
    assert html_extract.main_text(page(f"<article><p>{LONG}</p><p>a <span class=share>Share</span> b</p></article><section class=comments><p>{MUCH}</p></section>")) == f"{LONG}\na b"
    assert html_extract.main_text(page(f"<p>Lead <span class=comment>{MUCH}</span></p>")) == f"Lead {MUCH}"


NEUTRAL = [
    f"<div class=c1><a href=/>One</a> <a href=/>Two</a></div><div class=c2><h1>T</h1><p>{MUCH}</p><p>Short.</p><p>{MUCH}</p></div><div class=c3><p>Buy now, it is cheap.</p></div>" + "<div class=c4><div class=c5><p>Nice read, thanks!</p></div></div>" * 5,
    f"<div class=x1>Sale ends today</div><div class=x2><div class=x3><h2>T</h2><p>{MUCH}</p></div><div class=x3><p>Short.</p><p>{MUCH}</p></div></div><ul class=x4><li>First<li>Second<li>Third</ul><div class=x5>Call us</div>",
    f"<table><tr><td class=k1><a href=/>Home</a><br><a href=/>News</a></td></tr></table><h1>T</h1><p>{MUCH}</p><div class=k2><p>Short.</p></div><p>{MUCH}</p><div class=k3>All rights</div>",
]


@pytest.mark.parametrize("body", NEUTRAL)
def test_path_ratios_select_the_content(body, monkeypatch):
    """Noise with names that say nothing; with constant scores it comes along."""
    assert html_extract.main_text(page(body)) == f"T\n{MUCH}\nShort.\n{MUCH}"
    monkeypatch.setattr(html_extract, "path_scores", lambda blocks: np.ones(len(blocks)))
    assert html_extract.main_text(page(body)) != f"T\n{MUCH}\nShort.\n{MUCH}"


def test_path_scores_are_those_of_the_definition():
    blocks = [html_extract.Block(0, p, text=t, linked=n, weight=w) for p, t, n, w in ((1, "ab.", 0, 1.0), (2, "abcd", 2, 0.5), (1, "a,b,c", 0, 1.0), (3, "abcdef", 0, 1.5))]
    fused = {1: np.log1p(4) * (1 + np.log1p(1.5) / 2), 2: np.log1p(4) * 0.5, 3: np.log1p(6)}
    raw = [fused[b.path] for b in blocks]
    for k, got in enumerate(html_extract.path_scores(blocks)):
        near = [(html_extract.KERNEL[2 + j - k], raw[j]) for j in range(4) if abs(j - k) <= 2]
        assert np.isclose(got, sum(a * b for a, b in near) / sum(a for a, _ in near) * blocks[k].weight)


@pytest.mark.parametrize("tag", ["title-bar", "select-x", "object-y", "canvas-wrap", "style-guide", "script-font", "svg-icon"])
def test_custom_elements_are_not_raw(tag):
    assert html_extract.main_text(f"<body><{tag}>Head</{tag}><article><h1>T</h1><p>{MUCH}</p></article>") == f"T\n{MUCH}"
    assert html_extract.main_text(f"<body><article><{tag}><h1>T</h1><p>{MUCH}</p></{tag}></article>") == f"T\n{MUCH}"
    name = tag.split("-")[0]
    if name not in ("style", "script"):  # those run to the end of the page
        assert MUCH in html_extract.main_text(f"<body><div><{name}>x</div><article><p>{MUCH}</p></article>")


def test_an_article_paragraph_in_a_named_element_stays():
    got = html_extract.main_text(page(f"<article><h1>T</h1><p>{MUCH}</p><div class='related social'><p>{MUCH}</p></div><p>{MUCH}</p><div class=share>Share this</div></article>"))
    assert got == f"T\n{MUCH}\n{MUCH}\n{MUCH}"


def test_large_and_deep_pages_take_linear_time():
    for make in (lambda n: "<div class=x>a, b" * n, lambda n: "<b>" * n + "<p>x</p>" * n, lambda n: '<a title="x' * n, lambda n: "<title>" * n, lambda n: "<b><div>" * n + "</b>" * n, lambda n: "<!--" * n, lambda n: "<li>" * n + "x", lambda n: f"<p>{'x ' * 10 * n}</p>"):
        began = time.perf_counter()
        html_extract.main_text("<html><body>" + make(100_000))
        assert time.perf_counter() - began < 10
    assert html_extract.main_text("<div>" * 100_000 + LONG) == LONG


def test_pages_that_end_anywhere():
    whole = page(f"<nav>x</nav><article><h1>T</h1><p>{LONG}</p><p title=\"a>b\">{LONG} &am</p></article>")
    for n in range(0, len(whole), 7):
        assert "nav" not in html_extract.main_text(whole[:n])


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    assert sorted(tuple(r) for r in html_extract.extract_pages(df).select("page_id", "text", "n_chars").collect()) == [(1, LONG, len(LONG)), (2, "", 0)]
    assert html_extract.extract_pages(df.limit(0)).collect() == []
    twice = html_extract.extract_pages(df.unionByName(df).withColumn("n_chars", df.page_id)).collect()
    assert len(twice) == 4 and len(set(twice)) == 2


# -- quality ----------------------------------------------------------------


def noisy(rng, bad):
    w = ["".join(rng.choices("abcdeéfghi", k=rng.randrange(2, 7))) for _ in range(rng.randrange(5, 60))]
    return " ".join([x + rng.choice(["***", "%%%"]) for x in w] if bad == 1 else [x for x in w for _ in range(4)] if bad == 2 else w)


def test_quality_learns_and_scores_held_out_texts(spark):
    rng = random.Random(2)
    rows = [(i, noisy(rng, i % 3)) for i in range(240)] + [(900, None), (901, ""), (1, "x")]
    labels = [(i, int(i % 3 == 0), 0) for i in range(240)] + [(5, None, 0), (7, 3, 1), (None, 1, 1), (8, 1, 0), (9999, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, text int"), usable=quality.F.col("doc_id") % 2 == 0)
    scored = {r.doc_id: r.score for r in quality.score_documents(docs.where("doc_id <> 1"), model).collect()}
    assert len(scored) == 241 and all(0 <= s <= 1 for s in scored.values())
    held = [i for i in range(3, 240, 2)]
    assert np.mean([(scored[i] >= 0.5) == (i % 3 == 0) for i in held]) > 0.95
    assert quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int")).scores(["a", None]).tolist() == [0.5, 0.5]
    assert quality.fit(docs.limit(0), docs.selectExpr("doc_id", "1 as quality")).scores(["a"]).tolist() == [0.5]
    odd = docs.selectExpr("doc_id", "text", "'z' as id", "1 as label", "2 as h", "3 as other")
    again = quality.fit(odd.unionByName(odd.selectExpr("doc_id", "concat(text, ' z') as text", "id", "label", "h", "other")), spark.createDataFrame(labels, "doc_id long, quality int, text int"), usable=quality.F.col("doc_id") % 2 == 0)
    assert (again.weight == model.weight).all()  # a repeated id: the least of its texts; names that clash


def test_features_are_those_of_plain_python():
    texts = ["ab cab ab", "a", "", "é ab", "ab ab"]
    found = [sorted(f.tolist()) for f in quality.features(texts)]
    words = {w: next(iter(quality.features([w])))[0] for w in ("ab", "cab", "a", "é")}
    for text, feats in zip(texts, found, strict=True):
        w = text.split()
        grams = sum(max(0, len(f" {x} ".encode()) - n + 1) for x in w for n in quality.GRAMS)
        assert len(feats) == len(w) + 2 * max(0, len(w) - 1) + grams
        assert feats.count(quality.SAME) == sum(x == y for x, y in itertools.pairwise(w))
        assert all(feats.count(words[x]) >= w.count(x) for x in w)
    assert list(map(sorted, quality.features(["ab cab", "ab cab"])))[0] == list(map(sorted, quality.features(["cab ab", "ab cab"])))[1]


def test_training_is_that_of_plain_sgd():
    """The learned numbers, recomputed feature by feature."""
    rng = random.Random(8)
    texts, labels = [noisy(rng, k % 2) for k in range(12)], [1 - k % 2 for k in range(12)]
    model = quality.train(texts, labels, epochs=2)
    order = np.random.default_rng(quality.SEED)
    start = (order.random((quality.BUCKETS, quality.DIM), np.float32) - 0.5) / quality.DIM
    vector = {}
    layer, bias = [[0.0, 0.0] for _ in range(quality.DIM)], [0.0, 0.0]
    bags = [f.tolist() for f in quality.features(texts)]
    for epoch in range(2):
        step = quality.RATE * (1 - epoch / 2)
        for k in order.permutation(12):
            share = {f: bags[k].count(f) / len(bags[k]) for f in set(bags[k])}
            for f in share:
                vector.setdefault(f, [float(x) for x in start[f]])
            hidden = [sum(share[f] * vector[f][d] for f in share) for d in range(quality.DIM)]
            z = [sum(hidden[d] * layer[d][c] for d in range(quality.DIM)) + bias[c] for c in (0, 1)]
            p = [np.exp(x - max(z)) for x in z]
            p = [x / sum(p) for x in p]
            p[labels[k]] -= 1
            back = [sum(layer[d][c] * p[c] for c in (0, 1)) for d in range(quality.DIM)]
            for c in (0, 1):
                for d in range(quality.DIM):
                    layer[d][c] -= step * hidden[d] * p[c]
                bias[c] -= 0.05 * step * p[c]
            for f in share:
                for d in range(quality.DIM):
                    vector[f][d] -= step * min(len(share), 200) * share[f] * back[d]
    for f in vector:
        assert abs(model.weight[f] - sum(vector[f][d] * (layer[d][1] - layer[d][0]) for d in range(quality.DIM))) < 1e-3
    assert abs(model.bias - (bias[1] - bias[0])) < 1e-4


def test_score_is_the_mean_over_features():
    rng = random.Random(4)
    model = quality.Model(np.random.default_rng(0).normal(size=quality.BUCKETS).astype(np.float32), 0.3)
    texts = [noisy(rng, k % 3) for k in range(50)] + ["", None, "a", "a a a"]
    for got, feats in zip(model.scores(texts), quality.features(texts), strict=True):
        margin = 0.3 + (model.weight[feats].astype(float).mean() if len(feats) else 0)
        assert abs(got - 1 / (1 + np.exp(-margin))) < 1e-6


# -- tokens -----------------------------------------------------------------


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    texts = [t or "" for t in TEXTS]
    got = token_store.token_table(table(spark), tokenizer_path()).collect()
    start, want = 0, []
    for i in sorted(range(len(texts)), key=lambda i: (i != 4, i)):
        ids = [*whole.encode(texts[i], add_special_tokens=False).ids, 2]
        want.append((i if i != 4 else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_store.token_table(table(spark).limit(0), tokenizer_path()).collect() == []


#: Letters, marks and signs that the tokenizer normalises, cuts or takes for tokens of its own.
ODD = ["a", "B", "é", "É", "ß", "×", "÷", "Þ", "ÿ", "'", "'s", "'S", "’", "\u0301", "\u030c", "J", "I", "İ", "Σ", "ς", "ﬁ", "日", "1", "²", "½", ".", ",", "!", "*", "|", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "  ", "\n", "\t", "\r", "\xa0", "\u3000", "\x85", "😀", "\0", "ª", "º", "µ", "Ā", "A\u030a", "K", "n't", "'ll", "-", "_", "#", "$", "%", "&", "\u200b", "q", "Z"]


def test_ids_are_those_of_the_library(monkeypatch):
    import pyarrow as pa

    own, whole, rng = token_store.WordEncoder(tokenizer_path()), token_store.TextEncoder(tokenizer_path()), random.Random(5)
    monkeypatch.setattr(token_store, "CACHE", 3000)  # words are forgotten on the way
    texts = ["".join(rng.choices(ODD, k=rng.randrange(0, 14))) for _ in range(20_000)] + TEXTS[1:] + ["ab " * 400_000]
    for at in range(0, len(texts), 700):
        block = pa.array(["left out", *texts[at : at + 700]], pa.string()).slice(1)
        for got, want in zip(own.encode(block, 2), whole.encode(block, 2), strict=True):
            assert got.tolist() == want.tolist()
    assert own.words <= 3000 + 700 * 14


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    assert token_store.WordEncoder.fits(tokenizer_path())
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_store.WordEncoder.fits(other) and type(token_store.encoder(other)) is token_store.TextEncoder
    made = json.loads(open(tokenizer_path(), encoding="utf-8").read())
    made["normalizer"]["normalizers"].pop()  # without lower-casing
    (tmp_path / "cased.json").write_text(json.dumps(made))
    for path in (other, str(tmp_path / "cased.json")):
        library = Tokenizer.from_file(path)
        sizes, ids = token_store.encoder(path).encode(pa.array(["Hello, World's", "", "É é"]), 2)
        want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in ("Hello, World's", "", "É é")]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_ids_must_be_integers(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for refuse in (lambda: token_store.token_table(df, tokenizer_path()), lambda: near_dup.near_duplicates(df)):
        with pytest.raises(TypeError):
            refuse()


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 25, 32])
def test_packing(bits):
    for n in (0, 1, 7, 8, 9):
        few = np.random.default_rng(n).integers(0, 2**bits, n).astype(np.uint32)
        data = token_store.pack(few, bits)
        assert len(data) == -(-n * bits // 8) and int.from_bytes(data, "little") == sum(int(v) << k * bits for k, v in enumerate(few))
        assert token_store.unpack(data, bits, n).tolist() == few.tolist()
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype(np.uint32)
    assert (token_store.unpack(token_store.pack(ids, bits), bits, len(ids)) == ids).all()


def test_random_access(tmp_path):
    uri = f"file://{tmp_path}/x.tokens"
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 49408, n).astype(np.uint32) for n in (0, 1, 4095, 4096, 4097, 700_000, 3)]
    w = token_store.Writer(uri, 49408)
    for i, d in enumerate(docs):
        w.add(i if i else None, d)
    w.close()
    r = token_store.Reader(uri)
    flat = np.concatenate(docs)
    assert r.bits == 16 and r.count == len(flat)
    for a, b in [(0, 0), (0, 1), (4095, 4097), (8000, 500_000), (len(flat) - 1, len(flat))]:
        assert (r.ids(a, b) == flat[a:b]).all()
    assert [d for d, _ in r.documents()] == [None, 1, 2, 3, 4, 5, 6]
    assert all((a == b).all() for (_, a), b in zip(r.documents(), docs, strict=True))


# -- pieces -----------------------------------------------------------------


def every_segmentation(vocab, word):
    shown = word.replace("▁", "\U0010ffff").replace(" ", "▁")
    known = dict(zip(vocab.pieces, vocab.scores, strict=True))

    def go(i):
        if i == len(shown):
            yield 0.0
        for j in range(i + 1, min(len(shown), i + vocab.longest) + 1):
            cost = known.get(shown[i:j], vocab.unknown if j == i + 1 else None)
            if cost is not None:
                yield from (cost + rest for rest in go(j))

    return sorted(go(0), reverse=True)


def test_n_best_is_that_of_all_segmentations():
    own = pieces.Encoder(pieces.model_path())
    for word in [" hello", " Größe", "x▁y", " 日本x", "  two", " ", "a"]:
        every = every_segmentation(own.vocab, word)
        found = pieces.a_star(own.vocab, word, 5)
        assert np.allclose([s for s, _ in found], every[:5])
        assert all(own.decode(np.array([0, *ids], int) if False else np.array(ids, int)) == word.encode()[1:] for _, ids in found)
    for text in ["the cat", "ab\ncd"]:
        words, slots, _ = own.slots([text])
        sums = sorted((sum(c) for c in itertools.product(*[every_segmentation(own.vocab, w) for w in words[0]])), reverse=True)
        assert np.allclose(own.n_best(words[0], slots, 4), sums[:4])


def test_long_words_are_searched_in_proportion(monkeypatch):
    own = pieces.Encoder(pieces.model_path())
    for word, most in ((" " * 10_000, 4), (" " + "ab" * 5000, 4), (" " + "日" * 3000, 1)):
        began = time.perf_counter()
        found = pieces.a_star(own.vocab, word, 4)
        assert time.perf_counter() - began < 1 and len({tuple(ids) for _, ids in found}) == most
        assert all(own.decode(np.array(ids)) == word.encode()[1:] for _, ids in found)
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
    texts = [" " * 12, "ab" * 9, "x" * 14, "\n" * 3 + "日本語" * 4]
    short = []
    for t in texts:
        words, slots, _ = own.slots([t])
        short.append([(s, len(i)) for s, i in own.segmentations(words[0], slots, 5)])
        assert np.allclose([s for s, _ in pieces.a_star(own.vocab, t, 5)], every_segmentation(own.vocab, t)[:5])
    monkeypatch.setattr(pieces, "LONG", 3)
    again = pieces.Encoder(pieces.model_path())
    for t, want in zip(texts, short, strict=True):
        words, slots, _ = again.slots([t])
        found = again.segmentations(words[0], slots, 5)
        assert np.allclose([s for s, _ in found], [s for s, _ in want]) and all(again.decode(i) == t.encode() for _, i in found)


def test_n_best_ids_are_those_of_the_best_segmentations(spark):
    texts = [*[t for t in TEXTS if len(t or "") < 1000], "the cat", "ab\ncd", "Größe hello hello", "日本x the"]
    own = pieces.Encoder(pieces.model_path())
    score = dict(zip(own.vocab.ids.tolist(), own.vocab.scores.tolist(), strict=True))
    for n in (1, 2, 4, 7):
        for t in texts:
            words, slots, _ = own.slots([t or ""])
            found = own.segmentations(words[0], slots, n)
            assert len({tuple(ids) for _, ids in found}) == len(found) <= n and (found[0][1] == own.ids(slots)).all()
            assert all(own.decode(ids) == (t or "").encode() for _, ids in found)
            for s, ids in found:
                if not set(ids.tolist()) - set(score):  # without byte pieces
                    assert np.isclose(s, sum(score[i] for i in ids.tolist()))
        for t in ["the cat", "ab\ncd"]:
            words, slots, _ = own.slots([t])
            sums = sorted((sum(c) for c in itertools.product(*[every_segmentation(own.vocab, w) for w in words[0]])), reverse=True)
            assert np.allclose([s for s, _ in own.segmentations(words[0], slots, n)], sums[:n])
    for r in pieces.encode_documents(table(spark, texts), with_ids=True).collect():
        assert r.round_trip and r.ids == r.n_best_ids[0] and len(r.n_best_scores) == len(r.n_best_ids)
        assert r.n_best_pieces == [len(i) for i in r.n_best_ids] and r.n_best_pieces[0] == r.n_pieces
        assert r.n_best_crc32 == [zlib.crc32(np.array(i, "<u4")) for i in r.n_best_ids] and r.n_best_crc32[0] == r.ids_crc32


def test_encoding_decodes_to_the_text(spark):
    got = pieces.encode_documents(table(spark), with_ids=True).collect()
    assert len(got) == len(TEXTS) and all(r.round_trip and r.n_pieces == len(r.ids) and r.lang == "q" for r in got)
    assert all(list(r.n_best_scores) == sorted(r.n_best_scores, reverse=True) for r in got)
    assert pieces.encode_documents(table(spark).limit(0)).collect() == []


# -- languages ----------------------------------------------------------------


def test_word_probability_sums_over_segmentations():
    model = langid.train({"aa": ["abab abba baab"], "bb": ["zozo zoz ozo"]}, pieces.model_path())
    vocab = lattice.vocabulary(model.vocabulary)

    def total(word, k):
        word = "▁" + word
        known = vocab.index
        go = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - vocab.longest), j):
                p = model.p[known[word[i:j]], k] if word[i:j] in known else langid.STRANGE if j == i + 1 else 0
                go[j] += go[i] * p
        return np.log(go[-1])

    for word in ["abab", "zoz", "日本", "größe", "q" * 30]:
        assert np.allclose(model.log_words([word])[0], [total(word, 0), total(word, 1)])
    assert np.allclose(model.p.sum(axis=0), 1)


def test_languages(spark):
    rng = random.Random(1)
    parts = {"xx": ["the", "ing", "and", "tion"], "yy": ["ung", "sch", "der", "keit"]}
    make = lambda lang: " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(12))
    rows = [(i, make("xx" if i % 2 else "yy"), "xx" if i % 2 else "yy") for i in range(80)]
    docs = spark.createDataFrame([*rows, (90, None, "xx"), (91, "12 34 !", "yy"), (92, make("xx"), None), (92, make("xx"), None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, usable=langid.F.col("doc_id") % 5 != 0)
    got = langid.identify(docs, model).collect()
    assert all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in got if r.doc_id < 80)
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (90, 91)] == [("und", 0.0)] * 2
    assert [r.lang_pred for r in got if r.doc_id == 92] == ["xx", "xx"]
    odd = docs.selectExpr("doc_id", "text", "lang", "7 as h", "8 as n", "'u' as p")
    again = langid.fit(odd.unionByName(odd), usable=langid.F.col("doc_id") % 5 != 0)  # repeated rows are learned from once
    assert again.languages == model.languages and np.allclose(again.p, model.p, rtol=0.5)
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_long_words_and_many_languages(monkeypatch):
    rng = random.Random(6)
    names = [f"l{k:03d}" for k in range(70)]  # more than are scored at once
    model = langid.train({n: [" ".join("".join(rng.choices("abcdefgh"[k % 5 :], k=5)) for _ in range(20))] for k, n in enumerate(names)}, pieces.model_path())
    assert model.languages == names and np.allclose(model.p.sum(axis=0), 1)
    word = "".join(rng.choices("abcdefgh", k=150))
    short = model.log_words([word, "ab"])
    monkeypatch.setattr(langid, "REACH", 7)
    assert np.allclose(model.log_long(word), short[0])
    monkeypatch.setattr(langid, "LONG", 10)
    assert np.allclose(model.log_words([word, "ab"]), short)
    huge = "".join(rng.choices("abcdefgh", k=20_000))
    assert np.isfinite(model.log_long(huge)).all()
    assert langid.words_of(huge + "1" + word) == [huge, word]
    whole = langid.train({"aa": ["x " + "q" * 1000, None]}, pieces.model_path())
    assert whole.predict(["x", "q" * 1000, None, "1"]) == (["aa", "aa", "und", "und"], [1.0, 1.0, 0.0, 0.0])


def test_sample_is_bounded_for_each_language(spark):
    rows = [(k, f"t{k}", "aa") for k in range(900)] + [(None, "same", "bb")] * 500 + [(None, f"n{k}", "bb") for k in range(300)] + [(k, f"r{k}", "cc") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sampled(docs, "doc_id", "text", "lang", langid.F.lit(True), 50).groupBy("lang").count().collect()
    got = dict(map(tuple, got))
    assert (got["aa"], got["cc"]) == (50, 5) and 20 < got["bb"] <= 50  # where rows repeat, fewer are below the bound
    assert langid.sampled(docs.where("lang = 'cc'"), "doc_id", "text", "lang", langid.F.lit(True), 50).count() == 5


# -- media --------------------------------------------------------------------


def test_media_round_trip(spark):
    got = {r.doc_id: r for r in media_avi.media_digests(table(spark)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        media = media_avi.write_avi(list(media_avi.encode_frames(payload)))
        r = got[i if i != 4 else None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        # What is stored is AVI by the letter of RIFF, and each frame decodes bit by bit to the payload.
        at, chunks = media.index(b"movi") + 4, []
        while media[at : at + 4] == b"00dc":
            size = int.from_bytes(media[at + 4 : at + 8], "little")
            chunks.append(media[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
        assert media[at : at + 4] == b"idx1" and len(media) == 8 + int.from_bytes(media[4:8], "little")
        slow = np.concatenate([media_avi.decode_frame(f).ravel() for f in chunks[:9]])
        assert bytes(int(v) if v > 0 else int(v) + 255 for v in slow) == payload[: len(slow)]
    assert got[5].feature == got[11].feature
    assert media_avi.media_digests(table(spark).limit(0)).collect() == []


def test_long_payloads_are_read_in_steps(monkeypatch):
    rng = np.random.default_rng(3)
    payload = np.concatenate([rng.integers(lo, lo + 40, 576 * 40, dtype=np.uint8) for lo in (0, 128, 32, 215)]).tobytes()
    assert media_avi.cuts(payload) == [40, 80, 120]
    payload = payload[: 576 * 130] + b"a\xff" * 288 + payload[576 * 130 :]  # a frame with units 255
    media, found = media_avi.write_avi(media_avi.encode_frames(payload)), media_avi.cuts(payload)
    monkeypatch.setattr(media_avi, "STEP", 7)
    assert media_avi.write_avi(media_avi.encode_frames(payload)) == media and b"".join(media_avi.payload_steps(media)) == payload
    assert [c[1] for c in media_avi.clips_of(media)] == [0, *found]


def test_frames_decode_like_any_baseline_frame():
    payload = os.urandom(576 * 4) + bytes(range(256)) * 9
    frames = list(media_avi.encode_frames(payload))
    slow = np.concatenate([media_avi.decode_frame(f).ravel() for f in frames])
    assert bytes(int(v) if v > 0 else int(v) + 255 for v in slow) == payload == media_avi.decode_frames(frames)
    odd = [frames[0].replace(media_avi._segment(0xC4, b"\0" + media_avi.ZERO_CODE), media_avi._segment(0xC4, b"\0" + b"\0" * 7 + b"\x02" + b"\0" * 8 + b"\x08\x07"))]
    assert media_avi.decode_frames(odd) == payload[:576]


def coded(blocks, interval, ac_codes, dc_codes, dht):
    """A baseline frame of 24 x 24 from quantised coefficients, by the letter of the standard, with bytes 255 before markers."""
    parts = []
    for a in range(0, 9, interval):
        bits, before = "", 0

        def put(v, codes, run=0):
            size = abs(int(v)).bit_length()
            return codes[run << 4 | size] + (format(int(v) if v > 0 else int(v) + (1 << size) - 1, f"0{size}b") if size else "")

        for block in blocks[a : a + interval]:
            bits += put(int(block[0]) - before, dc_codes)
            before, run = int(block[0]), 0
            for k in range(1, 64):
                if block[k] == 0:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + ac_codes[0xF0], run - 16
                bits, run = bits + put(block[k], ac_codes, run), 0
            bits += ac_codes[0] if run else ""
        bits += "1" * (-len(bits) % 8)
        parts.append(int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0"))
    head = media_avi.HEADER[: media_avi.HEADER.index(b"\xff\xc4")] + dht + media_avi._segment(0xDD, interval.to_bytes(2, "big"))
    scan = b"".join(p + (b"\xff\xff" + bytes([0xD0 + k % 8]) if k < len(parts) - 1 else b"") for k, p in enumerate(parts))
    return head + media_avi._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + media_avi.END


def test_frames_of_other_coders():
    rng = np.random.default_rng(5)
    ac = [0, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
    lengths = {2: [1], 3: [0], 4: [2, 3], 8: ac[:40], 12: ac[40:]}  # codes of 8 and 12 bits for AC, of 2 to 11 for DC

    def table(symbols_by_length):
        codes, code, counts, symbols = {}, 0, [], []
        for n in range(1, 17):
            own = symbols_by_length.get(n, [])
            for symbol in own:
                codes[symbol] = format(code, f"0{n}b")
                code += 1
            code <<= 1
            counts.append(len(own))
            symbols += own
        return codes, bytes(counts) + bytes(symbols)

    ac_codes, ac_table = table({n: s for n, s in lengths.items() if n >= 8})
    dc_codes, dc_table = table({n: s for n, s in lengths.items() if n < 8} | {5: [4, 5], 11: list(range(6, 12))})
    dht = media_avi._segment(0xC4, b"\0" + dc_table) + media_avi._segment(0xC4, b"\x10" + ac_table)
    for interval in (9, 4, 1):
        want = rng.integers(-400, 401, (20, 9, 64)) * (rng.random((20, 9, 64)) < rng.choice([0.02, 0.3, 1], (20, 9, 1)))
        frames = [coded(f, interval, ac_codes, dc_codes, dht) for f in want]
        assert (media_avi.coefficients(frames) == want).all()
        mixed = [frames[0], *media_avi.encode_frames(bytes(range(192)) * 3), frames[1]]
        assert media_avi.frame_units(mixed)[1] == bytes(range(192)) * 3 and len(media_avi.decode_frames(mixed)) == 3 * 576
        for wrong in (frames[0][:-4] + media_avi.END, frames[0][:-2] + b"\0\0\0" + media_avi.END):
            with pytest.raises(ValueError):
                media_avi.decode_frames([frames[1], wrong])


def test_every_unit_is_read_through_its_code(monkeypatch):
    texts, read, real = ["a" * 3000, "", "né" * 900], [], media_avi._read
    media = [media_avi.write_avi(media_avi.encode_frames(media_avi.payload_of(t.encode()))) for t in texts]
    monkeypatch.setattr(media_avi, "_read", lambda window, at, table: read.append(len(at)) or real(window, at, table))
    monkeypatch.setattr(media_avi, "STEP", 4)
    got = [b""] * len(media)
    for i, part in media_avi.payload_parts(media):
        got[i] += part
    assert got == [media_avi.payload_of(t.encode()) for t in texts] and sum(read) == sum(map(len, got))


def test_shots_and_clips(spark):
    def scene(level, n):
        return bytes(np.random.default_rng(level).integers(level, level + 40, 576 * n, dtype=np.uint8))

    payload = scene(0, 30) + scene(100, 25) + scene(200, 20)
    assert media_avi.cuts(payload) == [30, 55]
    media = media_avi.write_avi(list(media_avi.encode_frames(payload)))
    df = spark.createDataFrame([(1, bytearray(media), 0.0)], "id long, media binary, start_s double")
    assert [tuple(r) for r in media_avi.clip_rows(df, "id").orderBy("clip").collect()] == [(1, 0, 0, 30, 0.0, 1.2), (1, 1, 30, 55, 1.2, 2.2), (1, 2, 55, 75, 2.2, 3.0)]
    with pytest.raises(ValueError):
        media_avi.read_avi(b"RIFX" + media[4:])
