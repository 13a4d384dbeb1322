"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words; decoding joins the tokens' bytes.

The main path is `round_trip`: inside each task, a text is cut by the vocabulary's pattern, each distinct word is folded
once per worker (up to `MEMO` are kept), and the ids are looked up word by word. The fold starts from single bytes and merges
the lowest-ranked neighbouring pairs, from the left, until no pair has a rank; words over `LONG` bytes keep their candidate pairs
in a heap, which takes n log n steps. `encode_words` is the same fold in Spark's higher-order functions over a table of words, with the
rank map as a literal. The README says why whole documents don't take that way.

Null counts as empty: no ids, and the hashes of nothing. Repeated rows get a row each, an empty table gives an empty result, and
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import ship

from .common import per_batch, pick, worker_memo

SLOTS = 1 << 16
MEMO = 300_000
LONG = 48
# Characters for which the pattern needs no Unicode tables: ASCII without controls, and the letters of Latin-1.
PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
PLAIN_CLASSES = ((r"\p{L}", "A-Za-zÀ-ÖØ-öø-ÿ"), (r"\p{N}", "0-9"))
PLAIN_SPACE = r"\t-\r\x20"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def plain_pattern(pattern: str) -> str:
    """The pattern for texts that PLAIN matches: its character classes spelled out."""
    for name, chars in PLAIN_CLASSES:
        pattern = pattern.replace(f"[^\\s{name}", f"[^\\s{chars}").replace(f"{name}+", f"[{chars}]+").replace(name, chars)
    return pattern.replace(r"[^\s", f"[^{PLAIN_SPACE}").replace(r"\S", f"[^{PLAIN_SPACE}]").replace(r"\s", f"[{PLAIN_SPACE}]")


def fold_bytes(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the lowest-ranked pair, the leftmost among equals, until none is left."""
    if len(data) > LONG:
        return fold_long(data, ranks)
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def fold_long(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same merges with a heap of (rank, start) and links between neighbours."""
    n = len(data)
    stop = list(range(1, n + 1)) + [n]          # a part is data[start:stop[start]]
    before = list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n + [False]
    while heap:
        _, a, end = heapq.heappop(heap)
        b = stop[a] if alive[a] else n
        if not alive[a] or b >= n or stop[b] != end:
            continue
        alive[b], stop[a] = False, end
        if end < n:
            before[end] = a
            if (r := ranks.get(data[a:stop[end]])) is not None:
                heapq.heappush(heap, (r, a, stop[end]))
        left = before[a]
        if left >= 0 and (r := ranks.get(data[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    out, at = [], 0
    while at < n:
        out.append(data[at:stop[at]])
        at = stop[at]
    return out


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        import regex
        self.ranks = read_ranks(path)
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.any, self.plain = regex.compile(pattern), re.compile(plain_pattern(pattern))
        self.memo: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """The ids of one word, as little-endian 32-bit words."""
        data = word.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else [self.ranks[p] for p in fold_bytes(data, self.ranks)]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        words = (self.plain if PLAIN.fullmatch(text) else self.any).findall(text)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            for w in set(words).difference(memo):
                memo[w] = self.word(w)
            return b"".join([memo[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
OUTPUTS = "doc_id bigint, ids binary, decoded binary"


def codec(path: str, pattern: str) -> Codec:
    return worker_memo(f"bytes {path} {pattern}", lambda: Codec(path, pattern))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """Per document the number of ids and the hashes of ids and decoded bytes; without `digests` the ids and bytes themselves."""
    def make():
        own = codec(path, pattern)

        def work(batch):
            ids = [own.encode(t) for t in batch.column("text").to_pylist()]
            decoded = [own.decode(i) for i in ids]
            if not digests:
                return {"doc_id": batch.column("doc_id"), "ids": ids, "decoded": decoded}
            return {"doc_id": batch.column("doc_id"), "n_tokens": [len(i) // 4 for i in ids],
                    "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                    "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded]}
        return work
    return per_batch(pick(docs, id_col, text_col), make, DIGESTS if digests else OUTPUTS, rows=200)


# The fold in higher-order functions. Bytes are Latin-1 characters there, so that the rank map can be written as text.

def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """An array of small maps, each with the pairs of one hash slot: a constant that the optimizer folds from its text."""
    table: list[dict] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        key = piece.decode("latin-1")
        table[zlib.crc32(key.encode()) % SLOTS][key] = rank
    return F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")


def find(table: Column, key: Column) -> Column:
    return F.try_element_at(F.element_at(table, (F.crc32(key) % SLOTS + 1).cast("int")), key)


def merge_once(table: Column, parts: Column) -> Column:
    """Merge the leftmost of the lowest-ranked pairs; the same parts if no pair has a rank."""
    ranks = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                        lambda i: find(table, F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))))
    at = let(ranks, lambda r: F.array_position(r, F.array_min(r)).cast("int"))
    return let(at, lambda i: F.when(i.isNull(), parts).otherwise(F.concat(
        F.slice(parts, F.lit(1), i - 1), F.array(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))),
        F.slice(parts, i + 2, F.size(parts)))))


def fold_native(table: Column, data: Column) -> Column:
    start = F.struct(F.split(data, "").alias("parts"), F.lit(False).alias("done"))
    step = lambda acc, _: F.when(acc["done"] | (F.size(acc["parts"]) < 2), acc).otherwise(                       # noqa: E731
        let(merge_once(table, acc["parts"]), lambda new: F.struct(new.alias("parts"), (F.size(new) == F.size(acc["parts"])).alias("done"))))
    return F.aggregate(F.sequence(F.lit(1), F.length(data)), start, step)["parts"]


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(word, ids) for a table of non-empty words, in SQL functions only."""
    table = rank_literal(ranks)
    data = F.decode(F.encode(F.col("word"), "UTF-8"), "ISO-8859-1")
    return words.select("word", let(data, lambda d: F.when(find(table, d).isNotNull(), F.array(find(table, d))).otherwise(
        F.transform(fold_native(table, d), lambda p: find(table, p)))).alias("ids"))


ship(__name__)
