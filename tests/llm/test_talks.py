"""Conversation trie and repair against plain versions."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import queries, repair, trie
from tests.oracle import connect, rows_of_spark, rows_of_sql

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def talks(spark, extra=False):
    """Short conversations, many alike at the start or as a whole, with nulls, ties, repeated rows, one long one and turnless ones."""
    r = random.Random(11)
    says = ["Yes.", "No!", "Why?", "so", "", " ", None, "\t", "é 中 😀.", "a.b. ", "x" * 50_000 + "."]
    rows = []
    for conv in [*range(0, 60), *range(100, 260, 2), -7, 990, 2001, 2002]:
        for turn in range(r.randint(1, 8)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", None, "", "usher", "tool"]) if r.random() < 0.3 else ["user", "assistant"][turn % 2]
            rows.append((conv, r.choice([turn, turn, turn, None, 3]), role, r.choice(says) if r.random() < 0.4 else "Yes."))
    for conv in (5000, 5001):
        rows += [(conv, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(300)]
    rows += rows[:5] + [(None, 0, "user", "nobody's"), (7000, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    if extra:
        for name in ("key", "path", "depth", "digest", "kind", "copy", "gone", "block", "base", "a.b"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def raw(df):
    return [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, role, hashed(f"{len(role)}:{role}{text}"), text))
    convs = {c: [(role, text) for _, _, role, _, text in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c / 100) * 100
        built[c] = tuple(convs.get(base, [])[:h] + v[h:])
    members, kids, sums, out = defaultdict(list), defaultdict(list), {}, []
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums[node] = sum(sums[k][0] for k in kids[node]) or 1, own + sum(sums[k][1] for k in kids[node])
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == node)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), *sums[node], hashed(ends)))
    return sorted(out, key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("block, few", [(100_000, 50), (20, 1), (150, 4)])
def test_trie(spark, monkeypatch, block, few):
    """Also with blocks so small that openings are cut at several depths and peeled level by level."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "FEW", few)
    df = talks(spark, extra=block == 20).filter(F.col("conv_id").isNull() | (F.col("conv_id") < 5000) | (F.col("turn") < 40))
    got = trie.prefix_trie(trie.with_shared_heads(trie.own_turns(df)))
    assert sorted(map(tuple, got.select(*TRIE).collect()), key=repr) == plain_trie(raw(df))


def test_trie_of_long_alike_and_no_conversations(spark):
    df = talks(spark).filter("conv_id >= 5000")
    got = trie.prefix_trie(trie.with_shared_heads(trie.own_turns(df)))
    assert sorted(map(tuple, got.select(*TRIE).collect()), key=repr) == plain_trie(raw(df))
    assert trie.prefix_trie(trie.with_shared_heads(trie.own_turns(df.limit(0)))).count() == 0


def plain_search(faults, initials):
    """Cheapest first, then by audit, without any bound."""
    heap, seen = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, made = heapq.heappop(heap)
        if (i, made[-1:]) in seen:
            continue
        seen.add((i, made[-1:]))
        if i == len(faults) and re.fullmatch("(s?(ua)+)?", made):
            return cost, audit
        after = [(3, "I", i, made + r) for r in "ua"]
        if i < len(faults):
            after.append((4, "D", i + 1, made))
            if faults[i] in "-t":
                more = 3 * (faults[i] == "t")
                after += [(more, "K", i + 1, made + initials[i])] + [(3 + more, "R", i + 1, made + r) for r in "ua"]
        for price, edit, j, roles in after:
            if re.fullmatch("s?(ua)*u?", roles):
                heapq.heappush(heap, (cost + price, audit + edit, j, roles))


def every_repair(faults, initials):
    """The best of all edits, up to two inserts at a place."""
    best = None
    edits = [["D"] + (["K", "u", "a"] if f in "-t" else []) for f in faults]
    for places in itertools.product(["", "u", "a", "ua", "au"], repeat=len(faults) + 1):
        for chosen in itertools.product(*edits):
            made, audit, cost = places[0], "I" * len(places[0]), 3 * len(places[0])
            for f, initial, edit, place in zip(faults, initials, chosen, places[1:]):
                made += {"D": "", "K": initial}.get(edit, edit) + place
                audit += (edit if edit in "DK" else "R") + "I" * len(place)
                cost += {"D": 4, "K": 0}.get(edit, 3) + 3 * (f == "t" and edit != "D") + 3 * len(place)
            if re.fullmatch("(s?(ua)+)?", made) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_search_finds_the_first_of_the_cheapest_audits():
    r = random.Random(2)
    for n in [0, 1, 1, 2] * 30:
        faults, initials = ("".join(r.choice(letters) for _ in range(n)) for letters in ("--tbd", "suax"))
        assert repair.repair(faults, initials) == every_repair(faults, initials) == plain_search(faults, initials)
    for _ in range(2000):
        n = r.randint(0, 25)
        faults, initials = ("".join(r.choice(letters) for _ in range(n)) for letters in ("----tbd", "suauauaua "))
        assert repair.repair(faults, initials) == plain_search(faults, initials)
    n = 100_000
    cost, audit = repair.repair("-t" * (n // 2), "".join(r.choice("suau ") for _ in range(n)))      # in proportion to the rows
    assert cost > 0 and sum(c != "I" for c in audit) == n


def plain_repairs(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is None:
            continue
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn is not None, turn or 0, role, hashed(text), text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, lines in convs.items():
        seen, faults = set(), ""
        for _, _, role, _, text in sorted(lines):
            bare = text.strip(" \t\n\v\f\r")
            faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
            seen.add((role, text))
        left = [(role, text) for _, _, role, _, text in sorted(lines)]
        initials = "".join((role or " ")[0] for role, _ in left)
        cost, audit = plain_search(faults, initials)
        made, last = [], ""
        for edit in audit:
            role, text = left.pop(0) if edit != "I" else ("", "")
            if edit in "RI":
                role = "assistant" if last == "u" else "user"
            if edit != "D":
                made.append((role, text))
                last = role[0]
        turns = [t for known, t, *_ in lines if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashed("\n".join(f"{a}:{b}" for a, b in made))), made
    return out


REPAIRS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("extra", [False, True])
def test_repairs(spark, extra):
    df = talks(spark, extra)
    rows = repair.damaged(df)
    wanted = plain_repairs(raw(df))
    got = repair.repair_report(rows).select(*REPAIRS).collect()
    assert sorted(map(tuple, got)) == sorted((c, *report) for c, (report, _) in wanted.items())
    texts = defaultdict(list)
    for conv, _, role, text in sorted(map(tuple, repair.rewrite(rows, repair.reports(rows)).collect())):
        texts[conv].append((role, text))
    assert texts == {c: made for c, (_, made) in wanted.items() if made}


def test_conversations_that_lose_every_row(spark):
    lost = [c for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(c, 0, "user", "Hello.") for c in lost], SCHEMA)
    got = sorted(map(tuple, repair.repair_report(repair.damaged(df)).select(*REPAIRS).collect()))
    assert got == [(c, 0, 0, 0, 0, 0, 0, "", hashed("")) for c in lost]
    assert repair.repair_report(repair.damaged(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_repair"])
def test_sql_twins(spark, sf_dir, name):
    assert rows_of_spark(queries.queries()[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), queries.oracle_sql()[name])
