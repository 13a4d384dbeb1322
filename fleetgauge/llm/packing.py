"""Best-fit packing of token sequences by large-item matching, planned on the histogram of lengths.

Pieces above a third of the capacity go at most two to a sequence: from the longest down, each is matched with the longest other
large piece that still fits. The smaller ones, from the longest down, go where they leave the least room. Pieces of one length are
interchangeable, so the plan needs only how many there are of each of the at most `capacity` lengths: it is a list of runs "the
pieces number a to b of this length go k to a sequence from sequence s on, at offset o". Its size depends on the capacity, not on
the corpus. Every piece then finds its place from its length and its number among the pieces of that length; numbering is
by salted buckets, sized from the histogram, so no length is numbered by one task.

Null counts as empty; every document ends in `end_id`, so an empty one is a piece of length one. Repeated rows are packed each.
An empty table packs into nothing. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.session import settle, ship

from .common import per_batch, pick, worker_memo

MEMO = 150_000
BUCKET_ROWS = 500
# Texts of these characters only are cut into words here; they are in composed form, and lower-casing maps one to one.
SLOW = re.compile(r"[^\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]|<\|")
CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")


class WordEncoder:
    """Token ids as little-endian bytes. Words of simple texts are encoded once per worker, other texts whole by the library."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(vocabulary)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode words in one call; every word's tokens end with one that carries the end-of-word mark."""
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        assert len(stops) == len(words)
        data, start = ids.tobytes(), 0
        for word, stop in zip(words, stops.tolist()):
            self.memo[word] = data[4 * start:4 * stop]
            start = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        cut = [None if SLOW.search(t) else CUT.findall(t.lower()) for t in texts]
        new = {w for words in cut if words for w in words}.difference(self.memo)
        if new:
            self.learn(sorted(new))
        known = self.memo.__getitem__
        return [self.whole(t) if words is None else b"".join(map(known, words)) for t, words in zip(texts, cut)]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """One row per piece of at most `capacity` ids. With `with_ids` the ids themselves come along, as little-endian 32-bit words."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def make():
        encoder = worker_memo(f"words {vocabulary}", lambda: WordEncoder(vocabulary))

        def work(batch):
            out = defaultdict(list)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                ids += end
                for number, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    out["doc_id"].append(doc)
                    out["piece"].append(number)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(part)
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
            return {n: pa.array(out[n], kinds[n]) for n in kinds if with_ids or n != "ids"}
        return work
    return per_batch(pick(docs, id_col, text_col), make, PIECES + (", ids binary" if with_ids else ""), rows=200)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first number, end number, first sequence, pieces per sequence, offset); numbers count from 0 by length."""
    left = dict(histogram)
    used: dict[int, int] = defaultdict(int)
    runs, gaps, n_sequences = [], defaultdict(list), 0       # gap: [(first sequence, how many)]
    rooms: list[int] = []                                     # gaps that occur, sorted

    def place(length, count, sequence, each, offset):
        runs.append((length, used[length], used[length] + count, sequence, each, offset))
        used[length] += count
        left[length] -= count

    def open_gap(room, sequence, count):
        if room and count:
            if room not in gaps:
                insort(rooms, room)
            gaps[room].append((sequence, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            fit = next((m for m in reversed(large) if m <= length and m + length <= capacity and left[m] > (m == length)), None)
            if fit is None:
                count = left[length]
                place(length, count, n_sequences, 1, 0)
                open_gap(capacity - length, n_sequences, count)
            elif fit == length:
                count = left[length] // 2
                place(length, 2 * count, n_sequences, 2, 0)
                open_gap(capacity - 2 * length, n_sequences, count)
            else:
                count = min(left[length], left[fit])
                place(length, count, n_sequences, 1, 0)
                place(fit, count, n_sequences, 1, length)
                open_gap(capacity - length - fit, n_sequences, count)
            n_sequences += count
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                count = -(-left[length] // each)
                open_gap(capacity, n_sequences, count)
                n_sequences += count
                continue
            room = rooms[at]
            sequence, count = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], rooms[at]
            each = room // length
            full = min(count, left[length] // each)
            place(length, full * each, sequence, each, capacity - room)
            open_gap(room - each * length, sequence, full)
            if full < count:
                rest = left[length]
                if rest:
                    place(length, rest, sequence + full, rest, capacity - room)
                    open_gap(room - rest * length, sequence + full, 1)
                open_gap(room, sequence + full + bool(rest), count - full - bool(rest))
    return [r for r in runs if r[2] > r[1]]


def numbered(cut: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Number the pieces of each length from 0: count by salted bucket, add up the buckets before, number inside the bucket.

    A bucket holds some BUCKET_ROWS pieces, or the root of their number where that is more, so that neither a bucket nor the
    list of a length's buckets outgrows a task.
    """
    salts = F.greatest(F.lit(1), F.ceil(F.col("total") / F.greatest(F.lit(float(BUCKET_ROWS)), F.sqrt("total"))))
    totals = cut.sparkSession.createDataFrame(sorted(histogram.items()), "length bigint, total bigint")
    salted = (cut.join(F.broadcast(totals), "length")                                    # at most `capacity` rows
              .withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "row"), salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "row"))
    return (salted.withColumn("inside", inside).join(starts, ["length", "salt"])
            .withColumn("number", F.col("before") + F.col("inside") - 1).drop("total", "salt", "inside", "before"))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece with the sequence it goes to and its place there."""
    spark = docs.sparkSession
    # Rows that are alike in everything, as empty texts without an id, still have a number of their own, so that their bucket splits.
    cut = settle(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids).withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}   # at most `capacity` rows
    runs = spark.createDataFrame(plan(histogram, capacity), "length bigint, first bigint, stop bigint, sequence bigint, each bigint, base bigint")
    by_length = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "stop", "sequence", "each", "base"))).alias("runs"))
    # The plan's size is bounded by the capacity. A piece's run is found in its length's sorted list.
    placed = (numbered(cut, histogram).join(F.broadcast(by_length), "length")
              .withColumn("run", F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("number")) & (F.col("number") < r["stop"])), 1)))
    ahead = F.col("number") - F.col("run.first")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("run.sequence") + F.floor(ahead / F.col("run.each"))).cast("bigint").alias("sequence_id"),
                         (F.col("run.base") + F.pmod(ahead, F.col("run.each")) * F.col("length")).cast("bigint").alias("offset"),
                         *(["ids"] if with_ids else []))


ship(__name__)
