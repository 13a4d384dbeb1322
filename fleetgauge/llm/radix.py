"""Exact duplicates by distributed MSD radix partitioning: groups split by successive bytes until they are single or ended.

A text's radix string is the number of its normalised bytes followed by the bytes themselves. Round 0 groups the rows by length and
the first `FIRST` bytes; every later round splits the groups still open by the next, `GROWTH` times longer, digit. A row leaves when it is
alone in its group, or when the group's bytes have ended: with the length in front all its members end together and are equal,
byte by byte. No digest decides anything. The rounds number log(longest text), and only rows of open groups are read again.

A group is never gathered: it is counted with partial aggregates, its number is joined back to its rows, and adaptive skew joins
split the rows of a very large group over tasks.

Null counts as empty. Rows are told apart by a row number of their own, so repeated rows (same id, same text) are copies of one another:
one of them stays. Of equal texts the row with the most code points stays, then the smallest id (null ids last), then the first
row. An empty table gives an empty result. `carry` names columns to hand on; they may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import settle

from .common import in_quotes

FIRST = 64
GROWTH = 32


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t-\r]+", "")


def split_round(rows: DataFrame, start: int, width: int, whole: bool) -> DataFrame:
    """One radix round: `rows` with their new group, whether they are alone in it; the text only where the group stays open, unless `whole`."""
    digit = F.substring(normalised().cast("binary"), start + 1, width)
    keyed = rows.withColumn("digit", digit)
    # A table of their own: a join against it has an exchange of its own on either side, which skew handling can split.
    groups = settle(keyed.groupBy("group", "digit").agg(F.count("*").alias("n"), F.min("rid").alias("next"))
                    .filter("n > 1").drop("n"))
    found = keyed.join(groups.hint("merge"), ["group", "digit"], "left")       # the same plan at every size
    alone = F.col("next").isNull()
    still = ~alone & (F.col("n_bytes") > start + width)
    return settle(found.select("rid", "id", "n_chars", "n_bytes", "sha", "payload", F.coalesce("next", "rid").alias("group"),
                               alone.alias("alone"), still.alias("open"), F.when(still | F.lit(whole), F.col("text")).alias("text")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, sha of the normalised text, and with `carry` the text and `payload` with those columns."""
    text = F.col(in_quotes(text_col)).cast("string")
    payload = F.struct(*[F.col(in_quotes(c)) for c in carry]) if carry else F.lit(None).cast("boolean")
    rows = (docs.select(F.monotonically_increasing_id().alias("rid"), F.col(in_quotes(id_col)).cast("bigint").alias("id"),
                        text.alias("text"), payload.alias("payload"))
            .select("*", F.octet_length(normalised()).cast("bigint").alias("n_bytes"),
                    F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"), F.sha2(normalised().cast("binary"), 256).alias("sha"))
            .withColumn("group", F.col("n_bytes")))
    start, width, ended = 0, FIRST, []
    while True:
        done = split_round(rows, start, width, bool(carry))
        ended.append(done.filter(~F.col("open")))
        rows = done.filter("open").drop("alone", "open")
        if rows.isEmpty():
            break
        start, width = start + width, width * GROWTH
    final = reduce(DataFrame.unionByName, [e.drop("open") for e in ended])
    handed = ["text", "payload"] if carry else []
    single = final.filter("alone").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                                          F.lit(True).alias("kept"), "sha", *handed)
    shared = final.filter(~F.col("alone"))
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("id").isNull().alias("z"), "id", "rid"))
    keepers = settle(shared.groupBy("group").agg(F.count("*").alias("group_size"), best.alias("best")))
    grouped = shared.join(keepers, "group").select("id", F.col("best.id").alias("keep_id"), "group_size",
                                                   (F.col("rid") == F.col("best.rid")).alias("kept"), "sha", *handed)
    return single.unionByName(grouped)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = exact_groups(docs, id_col, text_col)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of equal texts, with all columns of `docs`."""
    kept = exact_groups(docs, id_col, text_col, tuple(c for c in docs.columns if c != text_col)).filter("kept")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("payload")[c].alias(c) for c in docs.columns])
