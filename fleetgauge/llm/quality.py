"""Quality from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Each labeller votes good, bad or nothing on a text. All documents' votes are counted by pattern, at most 3^LABELLERS of them, and
expectation-maximisation on those counts estimates how often each labeller is right, and so the chance that a pattern's
documents are good. The scorer is a logistic regression over hashed words and stylistic marks, fitted to these chances on about
`fit_rows` documents drawn by a hash of their id (a documented bound); it then scores every whole document. Which labels there
are in the corpus is never used.

A null or empty text has no words: the labeller on plain words votes bad, the others abstain. Repeated rows count as often as they occur and get a row
each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import settle, ship

from .common import per_batch, pick, worker_memo

GOOD, BAD, NONE = "1", "0", "-"
LABELLERS = 10
BUCKETS = 1 << 15
MEMO = 300_000
SYMBOLS = b"#$%&*|~^=<>{}[]\\_@+"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
BOILER = ("click here", "lorem ipsum", "subscribe", "cookie", "javascript", "all rights reserved", "sign up")
SYMBOL = re.compile(r"[#$%&*|~^=<>{}\[\]\\_@+]")
PLAIN = re.compile(r"[\"'(]?[^\W\d_]+(?:['-][^\W\d_]+)*[.,;:!?)\"']?")
DOUBLED = re.compile(r"[!?]{2,}")
END = re.compile(r"[.!?][\"')\]]*$")
CLOSING = ".,;:!?)\"'"
ODD, PLAINLY, ENDS, TWICE = 1, 2, 4, 8
HOLDING = [bytes(code for code in range(16) if code & mark) for mark in (ODD, PLAINLY, ENDS, TWICE)]


def word_code(word: str) -> int:
    """Which of four marks a word has: holds a symbol, is plain, ends a sentence, doubles its marks."""
    if word.isalpha():
        return PLAINLY
    if word[-1] in CLOSING and word[:-1].isalpha():
        return PLAINLY | ENDS if word[-1] in ".!?" else PLAINLY
    return (ODD * bool(SYMBOL.search(word)) | PLAINLY * bool(PLAIN.fullmatch(word)) | ENDS * bool(END.search(word))
            | TWICE * bool(DOUBLED.search(word)))


class Words(dict):
    """Word that is not all letters to the code of its marks. Emptied when it holds MEMO words."""

    def __missing__(self, word: str) -> int:
        value = self[word] = word_code(word)
        return value

    def shares(self, words: list[str]) -> list[float]:
        if len(self) > MEMO:
            self.clear()
        rest = [w for w in words if not w.isalpha()]             # the others are plain and nothing else
        codes = bytes(map(self.__getitem__, rest))
        odd, plain, ends, doubled = (len(codes) - len(codes.translate(None, marked)) for marked in HOLDING)
        return [n / len(words) for n in (odd, plain + len(words) - len(rest), ends, doubled)]


def known_words() -> Words:
    return worker_memo("quality words", Words)


def share(chars: bytes, data: bytes) -> float:
    return 1 - len(data.translate(None, chars)) / len(data)


def repeats(words: list[str]) -> float:
    """The share of words that follow themselves."""
    return sum(map(eq, words, words[1:])) / len(words)


def look(text: str, known: Words) -> tuple[str, list[str], list[str]]:
    """(votes, words, marks) of a text. The labellers: symbols, words with symbols, capitals, plain words, sentences, doubled marks,
    repeated words, repeated pairs of words, repeated lines, boilerplate. Marks are stylistic features, hashed like words."""
    words = text.split()
    n = len(words)
    if n == 0:
        return NONE * 3 + BAD + NONE * (LABELLERS - 4), words, ["\0empty"]
    say = lambda bad, good: BAD if bad else GOOD if good else NONE                                               # noqa: E731
    data = text.encode()
    symbols, capitals, digits = (share(c, data) for c in (SYMBOLS, CAPITALS, DIGITS))
    odd, plain, ends, doubled = known.shares(words)
    sentences = 1 / max(ends, 1 / n)
    again = repeats(words)
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    small = text.lower()
    found = "".join([
        say(symbols > 0.04, symbols < 0.01),
        say(odd > 0.15, odd < 0.05),
        say(capitals > 0.3, capitals < 0.15),
        say(plain < 0.6, plain > 0.9),
        say(n > 20 and (sentences > 80 or sentences < 1.5), 3 <= sentences <= 40),
        say(doubled > 0.1, doubled < 0.01),
        say(again > 0.1, again < 0.02),
        say(n > 20 and pairs < 0.5, pairs > 0.8),
        say(len(lines) > 5 and len(set(lines)) < 0.5 * len(lines), False),
        say(any(b in small for b in BOILER), False),
    ])
    parts = {"symbols": symbols, "capitals": capitals, "digits": digits, "repeats": again, "pairs": 1 - pairs, "odd": odd}
    return found, words, [f"\0{k}{min(9, int(v * 50))}" for k, v in parts.items()]


def estimate(counts: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """The chance of "good" for each vote pattern, and [labeller, truth, vote] rates. Starts from the majority vote."""
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    seen = np.array([[[c == BAD, c == GOOD] for c in p] for p in patterns], float).reshape(-1, LABELLERS, 2)      # pattern, labeller, vote
    ballots = seen.sum(axis=1)
    good = (ballots[:, 1] + 1) / (ballots.sum(axis=1) + 2)
    rates = np.zeros((LABELLERS, 2, 2))
    for _ in range(rounds):
        truth = np.stack([1 - good, good], axis=1) * weight[:, None]
        # The added counts favour right votes, which keeps "good" from changing places with "bad".
        rates = np.einsum("pt,plv->ltv", truth, seen) + np.array([[2.0, 1.0], [1.0, 2.0]])
        rates /= rates.sum(axis=2, keepdims=True)
        prior = (truth.sum(axis=0) + 1) / (weight.sum() + 2)
        logs = np.log(prior) + np.einsum("plv,ltv->pt", seen, np.log(rates))
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -60, 60)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return dict(zip(patterns, good.tolist())), rates


def features(words: list[str], marks: list[str]) -> np.ndarray:
    """The distinct buckets of the words and marks, in order. No word holds a line break."""
    kinds = "\n".join(set(words).union(marks)).encode().split(b"\n")
    return np.unique(np.fromiter(map(zlib.crc32, kinds), np.uint32, len(kinds)) % BUCKETS)


def fit(rows: list[np.ndarray], target: np.ndarray, steps: int = 60, rate: float = 2.0, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps with per-weight rates; a document's features weigh 1/sqrt(their number)."""
    weights, bias, spread = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-6)
    if not rows:
        return weights, bias
    where = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = 1 / np.sqrt(np.bincount(doc, minlength=len(rows)))[doc]
    for _ in range(steps):
        margin = np.bincount(doc, weights[where] * value, len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(margin, -60, 60))) - target
        slope = np.bincount(where, error[doc] * value, BUCKETS) / len(rows) + ridge * weights
        spread += slope ** 2
        weights -= rate * 0.1 * slope / np.sqrt(spread)
        bias -= rate * error.mean()
    return weights, bias


VOTES = "doc_id bigint, votes string"
SCORES = "doc_id bigint, votes string, good_chance double, score double, keep boolean"


def score_quality(docs: DataFrame, threshold: float = 0.5, fit_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the votes, the chance of "good" they give, the scorer's score, and whether it reaches `threshold`."""
    texts = pick(docs, id_col, text_col)

    def count_votes():
        known = known_words()
        return lambda batch: {"doc_id": batch.column("doc_id"), "votes": [look(t, known)[0] for t in batch.column("text").to_pylist()]}

    voted = settle(per_batch(texts, count_votes, VOTES))
    counted = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}     # at most 3 ** LABELLERS
    chances, _ = estimate(counted)
    total = sum(counted.values())

    def example():
        known = known_words()

        def work(batch):
            seen = [look(t, known) for t in batch.column("text").to_pylist()]
            return {"votes": [v for v, _, _ in seen], "at": [features(w, m).tolist() for _, w, m in seen]}
        return work
    drawn = texts if total <= fit_rows else texts.filter(F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))
    sample = per_batch(drawn, example, "votes string, at array<int>").collect()      # about fit_rows rows of at most BUCKETS numbers
    weights, bias = fit([np.array(r["at"]) for r in sample], np.array([chances[r["votes"]] for r in sample]))
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias, chances))

    def score():
        table, start, chance = shared.value
        known = known_words()

        def work(batch):
            out = {"doc_id": batch.column("doc_id"), "votes": [], "good_chance": [], "score": []}
            for text in batch.column("text").to_pylist():
                found, words, marks = look(text, known)
                at = features(words, marks)
                margin = float(table[at].sum()) / np.sqrt(len(at)) + start
                out["votes"].append(found)
                out["good_chance"].append(chance[found])
                out["score"].append(float(1 / (1 + np.exp(-np.clip(margin, -60, 60)))))
            return out | {"keep": [s >= threshold for s in out["score"]]}
        return work
    return per_batch(texts, score, SCORES)


ship(__name__)
