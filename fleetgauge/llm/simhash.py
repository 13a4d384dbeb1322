"""SimHash fingerprints linked by multi-index hashing.

A fingerprint is a majority vote of the XXH64 bits of a text's three-word shingles. Documents with one fingerprint are a class, and
only classes are compared. Two fingerprints within two bits differ by at most one bit in their upper half, or agree in the lower
half. So each one probes the table of upper halves with its own half and with the Hamming ball of one bit around it (only bits set
from 0 to 1: the other end of a link sets the others), the table of lower halves with its own, and every candidate's whole distance
is verified.

Halves that over `CROWD` different fingerprints share are left out of these tables: comparing all within them would grow with the
square of the crowd. The fingerprints that hold such a half enumerate the whole ball of two bits around them, 2,080 values,
and look those up as whole fingerprints. Both ways are exact, so no link is lost and none costs more than the ball.

Null and empty texts have fingerprint zero and link like others. Rows that share a doc_id are told apart by their texts: each
has the component of its own fingerprint. A component's id is
its smallest doc_id; it is null only if the component has no other. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import settle, ship

from .common import in_quotes, per_batch, pick
from .graph import components

SEED = 42
WORDS = 3
CROWD = 256
DISTANCE = 2


def fingerprint(text: str) -> int:
    """Bits set in over half of the shingle hashes, as a signed 64-bit number."""
    import xxhash
    words = text.encode().lower().split()       # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1:])]
    votes, n = np.zeros(64, np.int64), len(hashes)
    for start in range(0, n, 65536):
        part = np.array(hashes[start:start + 65536], ">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row."""
    def make():
        def work(batch):
            return {"doc_id": batch.column("doc_id"), "fp": [fingerprint(t) for t in batch.column("text").to_pylist()]}
        return work
    return per_batch(pick(docs, id_col, text_col), make, "doc_id bigint, fp bigint")


def upper(fp: str | Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def lower(fp: str | Column) -> Column:
    return F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF)) if isinstance(fp, str) else fp.bitwiseAND(F.lit(0xFFFFFFFF))



def links(fps: DataFrame) -> DataFrame:
    """(u, v): all pairs of distinct fingerprints of `fps` (one row each) within two bits; a pair may come twice."""
    halves = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("half"), upper("fp").alias("key")),
                                                F.struct(F.lit(1).alias("half"), lower("fp").alias("key")))).alias("h")).select("fp", "h.*")
    crowds = halves.groupBy("half", "key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("half", "key")
    table = halves.join(crowds, ["half", "key"], "left_anti").withColumnRenamed("fp", "v")

    own = halves.select("fp", "half", "key", F.lit(False).alias("moved"))
    near = (fps.select("fp", upper("fp").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
            .filter("(own & shiftleft(1L, i)) = 0")
            .select("fp", F.lit(0).alias("half"), F.expr("own | shiftleft(1L, i)").alias("key"), F.lit(True).alias("moved")))
    found = (own.unionByName(near).withColumnRenamed("fp", "u").join(table, ["half", "key"])
             .filter((F.col("moved") | (F.col("u") < F.col("v"))) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE))
             .select("u", "v"))

    crowded = halves.join(crowds, ["half", "key"], "left_semi").select("fp").distinct()
    ball = (crowded.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
            .select("fp", "i", F.explode(F.sequence(F.col("i"), F.lit(63))).alias("j"))
            .select(F.col("fp").alias("u"), F.expr("fp ^ (shiftleft(1L, i) | shiftleft(1L, j))").alias("v")))
    return found.unionByName(ball.join(fps.select(F.col("fp").alias("v")), "v").select("u", "v"))


def fingerprint_components(marked: DataFrame) -> DataFrame:
    """(fp, component_id) for every fingerprint of `marked` (doc_id, fp)."""
    classes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, classes.fp == roots.vertex, "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint in hexadecimal, component_id."""
    marked = settle(with_fingerprint(docs, id_col, text_col))
    found = fingerprint_components(marked)
    return marked.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of their component, with all their columns. Rows without an id can't be
    told apart by it and stay."""
    members = near_duplicates(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    gone = (members.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
            .filter("NOT stays").select(F.col("doc_id").alias("gone_id")))
    return docs.join(gone, F.col(in_quotes(id_col)).cast("bigint") == gone["gone_id"], "left_anti")


ship(__name__)
