"""Repairs the structure of damaged conversations with as few edits as possible, by depth-first branch and bound.

Rows are taken by turn (null first), equal turns by role and then by the digest of the text. A row's first fault counts: blank (nothing but
white space), duplicate (role and text seen earlier in the conversation), truncated (the last character that is not white space ends no
sentence). Edits: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or assistant turn 3; a truncated row that isn't
deleted costs 3 more, and blank and duplicate rows have to be deleted. The roles' initials have to be `(s?(ua)+)?` in the end. Of the
cheapest audits (the edits' initials in order) the first in ASCII order is taken.

The search walks prefixes of edits with its own stack, first the edits that come first in ASCII order. A node is a row number and the role
that was written last. A prefix is left when its cost and the lower bound of its node's rest exceed the incumbent's cost, or equal it, as
later audits sort later (at the start, the incumbent is any audit above the root's bound); and when its node was reached before at no higher cost (dominance). The stack running empty proves the optimum.
The lower bounds come from one pass from the end that forgets the audits, so a search takes time and memory in proportion to the rows.

Two sorted passes: the first sees flags and digests only and writes a conversation's audit, the second sees the texts row by row and hashes
what is left of them, so a task never holds a conversation's texts, only some 150 bytes for each of its turns.

Null roles and texts are one space; so a null role fits nowhere, as an empty one, and a null text is blank. Rows without a conversation id
belong to no conversation. Repeated rows are repeated turns. An empty table gives an empty result. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import settle, ship

from .common import in_quotes

WHITE = " \t\n\x0b\f\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# What was written last: nothing, system, user, assistant. Complete are nothing and assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NEVER = 1 << 60


def numbered_columns(talks: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(in_quotes(c)).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text")))
    return talks.select(F.col(in_quotes(conv_col)).cast("bigint").alias("conv_id"), F.col(in_quotes(turn_col)).cast("bigint").alias("turn"),
                        role, text).filter("conv_id IS NOT NULL")


def damaged(talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by a hash of id and turn. Of twenty, one is lost (`gone`), one loses its text,
    one the ends of its sentences, one comes twice and one becomes the user's."""
    rows = numbered_columns(talks, conv_col, turn_col, role_col, text_col)
    turn = F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn)) % 20
    rows = rows.withColumn("kind", kind)
    text = (F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), times.alias("copy")).drop("copy")


def repair(faults: str, initials: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair. `faults` has a letter for each row (b, d, t, or - for none), `initials` its role's first one."""
    n = len(faults)
    stays = [f in "-t" for f in faults]
    extra = [TRUNCATED if f == "t" else 0 for f in faults]
    role = [INITIALS.get(c, -1) for c in initials]

    def fits(i: int, last: int) -> bool:
        """Whether row i can be kept after `last`."""
        return role[i] == NEXT[last] or role[i] == SYSTEM and last == NOTHING

    def with_inserts(costs: list[int]) -> list[int]:
        for _ in range(2):
            costs = [min(c, INSERT + costs[NEXT[last]]) for last, c in enumerate(costs)]
        return costs

    rest = [[]] * n + [with_inserts([0, NEVER, NEVER, 0])]
    for i in range(n - 1, -1, -1):
        after, costs = rest[i + 1], []
        for last in range(4):
            best = DELETE + after[last]
            if stays[i]:
                best = min(best, REROLE + extra[i] + after[NEXT[last]])
                if fits(i, last):
                    best = min(best, KEEP + extra[i] + after[role[i]])
            costs.append(best)
        rest[i] = with_inserts(costs)

    incumbent_cost, incumbent = rest[0][NOTHING] + 1, ""      # some audit has the cost of the root's bound; which one, the search finds
    reached = [[NEVER] * 4 for _ in range(n + 1)]
    audit: list[str] = []
    stack = [(0, NOTHING, 0, 0, "")]              # row, role written last, cost, length of the audit before the edit, the edit
    while stack:
        i, last, cost, length, edit = stack.pop()
        if cost + rest[i][last] >= incumbent_cost or cost >= reached[i][last]:
            continue
        reached[i][last] = cost
        del audit[length:]
        if edit:
            audit.append(edit)
        if i == n and last in (NOTHING, ASSISTANT):
            incumbent_cost, incumbent = cost, "".join(audit)
            continue
        length = len(audit)
        after = []
        if i < n:
            after.append((i + 1, last, cost + DELETE, length, "D"))
        after.append((i, NEXT[last], cost + INSERT, length, "I"))
        if i < n and stays[i]:
            if fits(i, last):
                after.append((i + 1, role[i], cost + KEEP + extra[i], length, "K"))
            after.append((i + 1, NEXT[last], cost + REROLE + extra[i], length, "R"))
        stack.extend(reversed(after))             # the last one in is looked at first
    return incumbent_cost, incumbent


class Talk:
    """The rows of one conversation, flag by flag."""

    def __init__(self, conv: int) -> None:
        self.conv, self.faults, self.initials, self.seen = conv, [], [], set()
        self.first, self.last, self.turns = None, None, 0

    def add(self, turn: int | None, initial: str, blank: bool, cut: bool, digest: bytes) -> None:
        if turn is not None:
            if turn != self.last:
                self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        self.faults.append("b" if blank else "d" if digest in self.seen else "t" if cut else "-")
        self.initials.append(initial)
        self.seen.add(digest)

    def report(self) -> tuple:
        faults, initials = "".join(self.faults), "".join(self.initials)
        cost, audit = repair(faults, initials)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        return self.conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit


REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
ORDER = ("conv_id", "turn", "role", "digest")


def reports(rows: DataFrame) -> DataFrame:
    """A row of REPORT per conversation of `rows` (conv_id, turn, role, text, gone)."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    flags = rows.select("conv_id", "turn", "role", "gone", F.unhex(F.sha2("text", 256)).alias("digest"), (bare == "").alias("blank"),
                        (~F.substring(bare, -1, 1).isin(*ENDS)).alias("cut"))
    types = [pa.int64()] * 7 + [pa.string()]
    names = [column.split()[0] for column in REPORT.split(", ")]

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 8, types)], names)

    def run(batches):
        talk = None
        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "gone", "digest", "blank", "cut"))
            for conv, turn, role, gone, digest, blank, cut in zip(*columns):
                if talk is None or conv != talk.conv:
                    if talk is not None:
                        found.append(talk.report())
                    talk = Talk(conv)
                if not gone:
                    talk.add(turn, role[:1] or " ", blank, cut, hashlib.sha256(b"%d:" % len(role) + role.encode() + digest).digest()[:16])
            yield batch_of(found)
        if talk is not None:
            yield batch_of([talk.report()])
    return flags.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(run, REPORT)


class Rewriter:
    """Says what becomes of the rows of a conversation, one after the other, and takes them in if it has a `sink`."""

    def __init__(self, audit: str, sink) -> None:
        self.audit, self.at, self.last, self.sink = audit, 0, NOTHING, sink

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.last = NEXT[self.last]
            self.sink(ROLES[self.last], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.last = INITIALS[role[0]]
            self.sink(role, text)
        elif edit == "R":
            self.last = NEXT[self.last]
            self.sink(ROLES[self.last], text)


class Lines:
    """The hash of `role:text` lines."""

    def __init__(self) -> None:
        self.digest, self.first = hashlib.sha256(), True

    def __call__(self, role: str, text: str) -> None:
        self.digest.update((("" if self.first else "\n") + role + ":" + text).encode())
        self.first = False


def audited(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The audit of each conversation, followed by its rows in order."""
    nothing = F.lit(None)
    texts = rows.filter("NOT gone").select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text",
                                           F.lit(1).alias("kind"), nothing.cast("string").alias("audit"))
    audits = report.select("conv_id", nothing.cast("bigint").alias("turn"), nothing.cast("string").alias("role"), nothing.cast("binary").alias("digest"),
                           nothing.cast("string").alias("text"), F.lit(0).alias("kind"), "audit")
    both = texts.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:])
    return both.select("conv_id", "kind", "audit", "role", "text")


def rewrite(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations."""
    def run(batches):
        plan, out = None, []
        conv = None
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                columns = (batch.slice(start, 1000).column(c).to_pylist() for c in ("conv_id", "kind", "audit", "role", "text"))
                for conv_id, kind, audit, role, text in zip(*columns):
                    if kind == 0:
                        if plan is not None:
                            plan.inserted()
                        conv, position = conv_id, [0]

                        def sink(role, text, conv=conv, position=position):
                            out.append((conv, position[0], role, text))
                            position[0] += 1
                        plan = Rewriter(audit, sink)
                    else:
                        plan.row(role, text)
                yield done(out)
                out.clear()
        if plan is not None:
            plan.inserted()
        yield done(out)

    def done(out):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)], ["conv_id", "position", "role", "text"])
    return audited(rows, report).mapInArrow(run, "conv_id bigint, position bigint, role string, text string")


def hashed(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of the repaired conversation's `role:text` lines."""
    def run(batches):
        plan = None

        def finished():
            conv, rewriter = plan
            rewriter.inserted()
            return conv, rewriter.sink.digest.hexdigest()

        def done(out):
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())],
                                              ["conv_id", "repaired_sha256"])
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                out = []
                columns = (batch.slice(start, 1000).column(c).to_pylist() for c in ("conv_id", "kind", "audit", "role", "text"))
                for conv_id, kind, audit, role, text in zip(*columns):
                    if kind == 0:
                        if plan is not None:
                            out.append(finished())
                        plan = conv_id, Rewriter(audit, Lines())
                    else:
                        plan[1].row(role, text)
                yield done(out)
        if plan is not None:
            yield done([finished()])
    return audited(rows, report).mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def repair_report(rows: DataFrame) -> DataFrame:
    """Per conversation of `rows` (as `damaged` makes them): REPORT and the hash of the repaired conversation."""
    report = settle(reports(rows))
    return report.join(hashed(rows, report), "conv_id")


ship(__name__)
