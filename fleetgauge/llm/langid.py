"""Language by known words first, then by ever shorter character n-grams.

`learn` counts words and n-grams per language over labelled rows; `predict` scores a known word by its log frequency in each
language, and an unknown one by the mean log frequency of its longest n-grams that any language knows. A document's score is the
sum over its words; the softmax of that is the confidence. Equal sums go to the language that sorts first.

One documented bound keeps the model small whatever the corpus: it is fitted on about `fit_rows` labelled rows, drawn by a hash of
their id. They are shared out among the languages, so that one with few rows is learned as well as it can be: every language has
the same room, and leaves what it doesn't need to the others. All words and n-grams of those rows are in the model, as a sorted array of
64-bit hashes that a batch's words are searched in together. Prediction reads only the text.

A text that is null or has no letter is "und" with score 0, and so is every text if no row has a language. Repeated rows count
as often as they occur and each get a row. An empty table gives an empty result. Rows without an id are not learned from.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import ship

from .common import map_rows, per_batch, pick

LONGEST = 5
WORD = re.compile(r"[^\W\d_]+")
MEMO = 150_000
UNKNOWN = "und"


def words(text: str) -> list[str]:
    """Runs of letters, in lower case. Number signs that count as word characters, such as superscripts, are cut out."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def key_of(n: int, gram: str) -> int:
    """64 bits for a known word (n = 0) or an n-gram; two of a model's entries share them with a chance of about 1 in 10 million."""
    import xxhash
    return xxhash.xxh64_intdigest(gram, n)


class Model:
    """Log frequencies by language: a row of `matrix` for each entry of the sorted `keys`. Some 25 bytes an entry with four languages."""

    def __init__(self, langs: list[str], counts: pa.Table) -> None:
        """`counts` has (n, gram, lang, count), one row for each of their combinations."""
        self.langs = langs
        n = counts.column("n").to_numpy()
        keys = np.concatenate([np.empty(0, np.uint64)] + [np.fromiter(map(key_of, b.column("n").to_pylist(), b.column("gram").to_pylist()), np.uint64, b.num_rows)
                                                          for b in counts.to_batches(max_chunksize=50_000)])
        self.keys, first, row = np.unique(keys, return_index=True, return_inverse=True)
        at = {lang: i for i, lang in enumerate(langs)}
        matrix = np.zeros((len(self.keys), len(langs)), np.float32)
        lang = np.fromiter((at[str(v)] for v in counts.column("lang")), np.int64, len(n))
        np.add.at(matrix, (row, lang), counts.column("count").to_numpy().astype(np.float32))
        length = n[first]
        for k in range(LONGEST + 1):
            own = length == k
            total = matrix[own].sum(axis=0, dtype=float) + 0.5 * (own.sum() + 1)
            matrix[own] = np.log((matrix[own] + 0.5) / total)
        self.matrix = matrix

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for one that is unknown."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): each word by itself if it is known, else by the mean of its longest n-grams that any language knows."""
        out = np.zeros((len(words), len(self.langs)))
        found = self.rows(np.fromiter((key_of(0, w) for w in words), np.uint64, len(words)))
        out[found >= 0] = self.matrix[found[found >= 0]]
        left = np.nonzero(found < 0)[0]
        for n in range(LONGEST, 0, -1):
            parts = [grams(words[i], n) for i in left.tolist()]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            rows = self.rows(np.fromiter((key_of(n, g) for p in parts for g in p), np.uint64, int(sizes.sum())))
            owner, known = np.repeat(np.arange(len(parts)), sizes), rows >= 0
            count = np.bincount(owner[known], minlength=len(parts))
            hit = count > 0
            if hit.any():
                starts = np.concatenate([[0], np.cumsum(count[hit])[:-1]])
                out[left[hit]] = np.add.reduceat(self.matrix[rows[known]].astype(float), starts) / count[hit, None]
            left = left[~hit]
            if not len(left):
                break
        return out

    def score(self, word: str) -> np.ndarray:
        return self.scores([word])[0]


class Scorer(dict):
    """Word to row of `matrix`; words are scored when first seen, a batch at a time, and forgotten when there are over MEMO of them."""

    def __init__(self, model: Model) -> None:
        self.model, self.matrix = model, np.empty((1024, len(model.langs)))

    def learn(self, fresh: list[str]) -> None:
        for start in range(0, len(fresh), 20_000):
            some, row = fresh[start:start + 20_000], len(self)
            while row + len(some) > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
            self.matrix[row:row + len(some)] = self.model.scores(some)
            self.update(zip(some, range(row, row + len(some))))

    def predict_all(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        found = [words(t) for t in texts]
        wanted = set().union(*found)
        if len(self) + len(wanted) > MEMO:
            self.clear()
        self.learn(list(wanted.difference(self)))
        return [self.of(f) for f in found]

    def of(self, found: list[str]) -> tuple[str, float]:
        if not found:
            return UNKNOWN, 0.0
        sums = np.zeros(len(self.model.langs))
        for start in range(0, len(found), 100_000):
            rows = [self[w] for w in found[start:start + 100_000]]
            sums += self.matrix[rows].sum(axis=0)
        best = int(sums.argmax())
        return self.model.langs[best], float(1 / np.exp(sums - sums[best]).sum())

    def predict(self, text: str) -> tuple[str, float]:
        return self.predict_all([text])[0]


def gram_counts(batch) -> dict:
    """Words and n-grams of one batch, counted by language."""
    by_lang: dict[str, Counter] = {}
    for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
        by_lang.setdefault(lang, Counter()).update(words(text))
    out: dict[str, list] = {"n": [], "gram": [], "lang": [], "count": []}
    for lang, seen in by_lang.items():
        for n in range(LONGEST + 1):
            counts: Counter = Counter()
            if n == 0:
                counts = seen
            else:
                for word, times in seen.items():
                    for gram in grams(word, n):
                        counts[gram] += times
            out["n"] += [n] * len(counts)
            out["gram"] += list(counts.keys())
            out["lang"] += [lang] * len(counts)
            out["count"] += list(counts.values())
    return out


def shares(sizes: dict, room: int) -> dict:
    """How many of its `sizes` entries each key gets of `room`: the same for all, and what small ones leave goes to the others."""
    given, left = {}, room
    for i, key in enumerate(sorted(sizes, key=lambda k: (sizes[k], k))):
        given[key] = min(sizes[key], left // (len(sizes) - i))
        left -= given[key]
    return given


def drawn(rows: DataFrame, fit_rows: int) -> DataFrame:
    """About `fit_rows` of `rows`, of every language the same number as far as it has them."""
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}      # a row per language
    if sum(sizes.values()) <= fit_rows:
        return rows
    parts = [(lang, -(-1_000_000 * n // sizes[lang])) for lang, n in shares(sizes, fit_rows).items()]
    part = rows.sparkSession.createDataFrame(parts, "lang string, part bigint")
    return rows.join(F.broadcast(part), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("part")).drop("part")


def learn(labelled: DataFrame, fit_rows: int = 40_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about `fit_rows` of the rows with a language; every word and n-gram in them counts."""
    rows = labelled.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                           F.col(f"`{lang_col}`").cast("string").alias("lang")).filter("lang IS NOT NULL AND doc_id IS NOT NULL")
    counts = (per_batch(drawn(rows, fit_rows).select("doc_id", "text", "lang"), lambda: gram_counts,
                        "n int, gram string, lang string, count bigint", rows=1500)
              .groupBy("n", "gram", "lang").agg(F.sum("count").alias("count")).toArrow())          # what `fit_rows` texts hold
    return Model(sorted(map(str, counts.column("lang").unique())), counts)


LANGS = "doc_id bigint, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: whether it was held out of learning, the language and the confidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)      # what `fit_rows` texts hold

    def make():
        scorer = Scorer(shared.value)

        def work(batch):
            found = scorer.predict_all(batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                    "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}
        return work
    picked = pick(docs, id_col, text_col)
    return per_batch(picked.withColumn("held_out", held_out()), make, LANGS)


def keep_known(docs: DataFrame, model: Model, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, unchanged, whose text has a language at a confidence of `min_score` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def work(batch, at):
            found = scorer.predict_all([t or "" for t in batch.column(at).to_pylist()])
            return batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))
        return work
    return map_rows(docs, make, text_col)


ship(__name__)
