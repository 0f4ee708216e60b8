"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations of the product of
their pieces' probabilities, which a forward pass over the word's lattice gives
exactly; a text's is the product over its words, and languages are equally likely
beforehand. A word may be foreign with a small chance: it is then of any of the
languages, so its probability is a mixture of these same marginals, and segments
of a text in another language cannot outweigh it. Probabilities are learned by
expectation maximisation (forward-backward over the same lattices) from a bounded
sample of documents, in one task; all languages are learned, at 0.25 MB each.

Words are maximal runs of letters, of any length, lower-cased, with the
vocabulary's sign for a space in front. All distinct words of a block are scored
together, some languages at a time; a run over LONG letters is scored by itself in
steps of bounded memory, and not learned from.

Defined cases: a text that is null or has no letter is `und` with score 0; rows
without a language are not learned from, and of rows that repeat an id and a text
one is; with no learned language every text is `und`; of languages that tie the
first in alphabetical order wins; repeated rows give repeated results; other
columns are not looked at, also if they have the names that are used here.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lattice
from .pieces import model_path, text_blocks
from .store import claim, materialize, scratch, trim, tune, unused

#: Documents learned from for each language, at most: those whose ids and texts hash lowest.
SAMPLE = 250
#: Languages whose counts are broadcast, at most; more are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
#: Log probabilities remembered by a task before it starts afresh.
CACHE = 1 << 20
#: Languages scored at once: bounds the memory of a lattice's sums.
WIDE = 32
#: Letters of a word that is scored by itself, and letters of it that are looked up at once.
LONG, REACH = 200, 1 << 14
ROUNDS, SMOOTHING, UNDETERMINED = 3, 0.02, "und"
#: Chance that a word isn't of its text's language.
FOREIGN = 0.1
#: Words counted at once: bounds the memory of training.
STEP = 10_000
#: Probability of a letter that is no piece, in every language. Factors per letter keep long words within doubles.
STRANGE, PER_LETTER = 1e-9, 12.0
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


@dataclass
class Model:
    vocabulary: str
    languages: list[str]
    p: np.ndarray  # pieces x languages

    def __post_init__(self) -> None:
        self._forget()

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "languages": self.languages, "p": self.p}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, len(self.languages)))

    def log_words(self, words: list[str]) -> np.ndarray:
        """log P(word | language), a row for each word."""
        out = np.empty((len(words), len(self.languages)))
        short = np.array([k for k, w in enumerate(words) if len(w) <= LONG], np.int64)
        e = lattice.edges(lattice.vocabulary(self.vocabulary), [" " + words[k] for k in short])
        ends = e.starts + e.lengths
        for a in range(0, len(self.languages), WIDE):
            p = self.p[:, a : a + WIDE]
            out[short, a : a + WIDE] = np.log(lattice.total(e, _scaled(e, p))[ends]) - (e.lengths * np.log(PER_LETTER))[:, None]
        for k in set(range(len(words))) - set(short.tolist()):
            out[k] = self.log_long(words[k])
        return out

    def log_long(self, word: str) -> np.ndarray:
        """The same for one long word: the sums of the last places are carried along, scaled to stay within doubles."""
        vocab, word = lattice.vocabulary(self.vocabulary), " " + word
        reach, scale = vocab.longest, np.zeros(len(self.languages))
        sums = np.zeros((reach + 1, len(self.languages)))  # of the places from `at` on
        sums[0] = 1.0
        for at in range(0, len(word), REACH):
            size = min(REACH, len(word) - at)
            e = lattice.edges(vocab, [word[at : at + size + reach - 1]])
            local = np.zeros((size + reach + 1, len(self.languages)))
            local[: reach + 1] = sums
            for t in range(size):
                top = local[t]
                ahead = local[t : t + reach + 1].max(axis=0)
                small = (ahead > 0) & (ahead < 1e-100)
                if small.any():
                    factor = np.where(small, ahead, 1.0)
                    local[t : t + reach + 1] /= factor
                    scale += np.log(factor)
                for k in range(e.groups[t], e.groups[t + 1]):
                    piece = e.piece[k]
                    local[e.target[k]] += top * (self.p[piece] if piece >= 0 else STRANGE)
            sums = local[size : size + reach + 1]
        return np.log(sums[0]) + scale

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for block in text_blocks([t or "" for t in texts]):
            split = [words_of(t) for t in block]
            if self.table.size > CACHE:
                self._forget()
            new = sorted({w for words in split for w in words if w not in self.place}) if self.languages else []
            if new:
                self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
                self.table = np.concatenate((self.table, with_strangers(self.log_words(new))))
            flat = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64) if self.languages else np.empty(0, np.int64)
            table = self.table
            cut = np.concatenate(([0], np.cumsum([len(w) for w in split]))).astype(np.int64)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b or not self.languages:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                odds = table[flat[a:b]].sum(axis=0)
                odds = np.exp(odds - odds.max())
                k = int(odds.argmax())
                names.append(self.languages[k])
                scores.append(round(float(odds[k] / odds.sum()), 9))
        return names, scores


def with_strangers(logs: np.ndarray) -> np.ndarray:
    """A word of a text is of any language with a chance of FOREIGN, so that no word, and no quoted passage, weighs without bound."""
    top = logs.max(axis=1, keepdims=True)
    odds = np.exp(logs - top)
    return np.log((1 - FOREIGN) * odds + FOREIGN * odds.mean(axis=1, keepdims=True)) + top


def _scaled(e: lattice.Edges, p: np.ndarray) -> np.ndarray:
    known = np.where((e.piece >= 0)[:, None], p[e.piece], STRANGE)
    return known * (PER_LETTER ** (e.target - e.source).astype(float))[:, None]


def train(samples: dict[str, list[str | None]], vocabulary: str) -> Model:
    """samples: texts of each language."""
    languages = sorted(samples)
    vocab = lattice.vocabulary(vocabulary)
    counts = [Counter(chain.from_iterable(map(words_of, samples[name]))) for name in languages]
    words = sorted(w for w in set().union(*counts) if len(w) <= LONG)
    size = len(vocab.pieces)
    p = np.full((size, len(languages)), 1.0 / size)
    if not words:
        return Model(vocabulary, [], p)
    for _ in range(ROUNDS):
        found = np.zeros_like(p)
        for a in range(0, len(words), STEP):
            some = words[a : a + STEP]
            often = np.array([[c[w] for c in counts] for w in some], float)
            e = lattice.edges(vocab, [" " + w for w in some])
            owner = np.searchsorted(e.starts, e.source, side="right") - 1
            q = _scaled(e, p)
            alpha, beta = lattice.total(e, q), lattice.total_back(e, q)
            share = alpha[e.source] * q * beta[e.target] / alpha[e.starts + e.lengths][owner] * often[owner]
            real = e.piece >= 0
            for k in range(len(languages)):
                found[:, k] += np.bincount(e.piece[real], weights=share[real, k], minlength=size)
        found += SMOOTHING
        p = found / found.sum(axis=0)
    return Model(vocabulary, languages, p)


def sampled(documents: DataFrame, key: str, text: str, lang: str, usable: Column, size: int) -> DataFrame:
    """(lang, h, text) of at most `size` documents of each language."""
    known = documents.where(usable).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h")).where("lang is not null and text is not null")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    counts = materialize(counts, scratch(documents.sparkSession, "languages"))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_LANGUAGES else counts
    # Hashes below a bound that twice as many rows pass leave few rows to rank, however many a language has.
    near = known.join(counts, "lang").where(F.pmod("h", F.lit(1 << 40)) / F.lit(float(1 << 40)) < F.lit(2.0 * size) / F.col("n"))
    near = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "h", "text")


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", usable: Column | None = None, size: int = SAMPLE, vocabulary: str | None = None) -> Model:
    """Trains in a task on at most `size` documents of each language."""
    tune(documents.sparkSession)
    path = vocabulary or model_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        samples: dict[str, list[str | None]] = {}
        for batch in batches:
            for name, words in zip(batch["lang"], batch["text"], strict=True):
                samples.setdefault(name, []).append(words)
        model = train(samples, path)
        for k, name in enumerate(model.languages):
            yield pd.DataFrame({"lang": [name], "p": [model.p[:, k].tobytes()]})
        trim()

    rows = sampled(documents, key, text, lang, F.lit(True) if usable is None else usable, size)
    found = sorted(rows.repartition(1).mapInPandas(run, "lang string, p binary").collect())  # a row of 0.25 MB for each language
    return Model(path, [r.lang for r in found], np.stack([np.frombuffer(r.p) for r in found], axis=1) if found else np.zeros((0, 0)))


def identify(documents: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """documents with the most likely language and its probability."""
    tune(documents.sparkSession)

    @F.pandas_udf("struct<lang:string,score:double>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("languages", model._forget)
        for batch in batches:
            names, scores = model.predict(batch.tolist())
            yield pd.DataFrame({"lang": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype="float64")})
            trim()

    name = unused(documents, "found")
    out = documents.withColumn(name, found(F.col(text)))
    return out.select(*[c for c in documents.columns if c not in (lang, score)], F.col(f"{name}.lang").alias(lang), F.col(f"{name}.score").alias(score))
