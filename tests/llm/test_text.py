"""PII, token counts, byte-level BPE and packing against brute force and the libraries."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetgauge.llm import bpe, packing, pii, tokens

from .frames import AWKWARD, documents, rows_of, texts

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab0123459.+-@ ()_%", max_size=60))
def test_base_spans(text):
    assert [f"{k}:{a}:{b}" for k, a, b, _ in pii.spans(text) if k in pii.KINDS[:pii.BASE]] == plain_spans(text)


def test_added_kinds():
    kinds = lambda t: [k for k, *_ in pii.spans(t)]                                                    # noqa: E731
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("DE89370400440532013001") == []
    assert kinds("my social security number is 123-45-6789") == ["ssn"]
    assert kinds("part 123-45-6789") == []
    assert kinds("call (212) 555-0100") == ["local_phone"] and kinds("(212) 555-0100") == []
    assert pii.masked("write to a@b.co or +1 212 555 0100!") == "write to <EMAIL> or <PHONE>!"


def test_find_pii(spark):
    for extra in (False, True):
        docs = documents(spark, extra)
        got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.find_pii(docs).collect())
        want = Counter()
        for i, t in rows_of(docs):
            s = plain_spans(t or "")
            want[(i, *(sum(x.startswith(k + ":") for x in s) for k, _ in BASE), hashlib.sha256(",".join(s).encode()).hexdigest())] += 1
        assert got == want
        clean = pii.redact(docs)
        assert clean.columns == docs.columns and clean.count() == docs.count()
        assert not any(plain_spans(t) for _, t in rows_of(clean) if t)


@pytest.fixture(scope="module")
def counter():
    return tokens.PieceCounter(P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="abehinorst THE.,'\"-1290\n\t▁éßç中😀", max_size=40))
def test_token_counts(counter, pieces, text):
    assert counter.count(text) == len(pieces.encode(text))


def test_prefix_counts(counter, pieces):
    for text in [t for t in AWKWARD if t and len(t) < 500] + texts(10):
        mine = counter.prefix_counts(text.replace(" ", tokens.MARK))
        sizes = [len(pieces.encode(text[:i])) for i in range(len(text) + 1)]
        chunks, at, used = counter.chunks(text), 0, 0
        for chunk in chunks:
            inside = counter.prefix_counts(chunk)
            for i in range(1, len(chunk) + 1):
                if at + i - 1 > 0:
                    assert used + inside[i] == sizes[at + i - 1]
            at, used = at + len(chunk), used + inside[-1]
        assert len(mine) == len(text) + 1
        for budget in (0, 1, 5, 17, 10_000):
            assert counter.fit(text, budget) == max(i for i, n in enumerate(sizes) if n <= budget)


def test_count_tokens(spark, pieces):
    for extra in (False, True):
        docs = documents(spark, extra)
        got = Counter(map(tuple, tokens.count_tokens(docs, P.path("piece_bpe_32k.model"), 50).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()))
        want = Counter((i, len((t or "").encode()), n := len(pieces.encode(t or "")), n > 50) for i, t in rows_of(docs))
        assert got == want
    table = {r["doc_id"]: r for r in tokens.prefix_table(docs, P.path("piece_bpe_32k.model")).collect()}
    assert table[6]["ends"][-1] == len(AWKWARD[6]) and table[6]["counts"][-1] == len(pieces.encode(AWKWARD[6])) and table[0]["ends"] == []


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def le(ids):
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="abest THE'slvd.,!#12\n\t é中²\u00a0\u2003😀", max_size=60), st.text(alphabet="aab", min_size=49, max_size=200), st.text(max_size=40)))
def test_byte_bpe(codec, library, text):
    ids = codec.encode(text)
    assert ids == le(library.encode_ordinary(text)) and codec.decode(ids) == text.encode()


def test_round_trip(spark, library):
    for extra in (False, True):
        docs = documents(spark, extra)
        got = Counter(map(tuple, bpe.round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()))
        want = Counter()
        for i, t in rows_of(docs):
            ids = library.encode_ordinary(t or "")
            want[i, len(ids), hashlib.sha256(le(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
        assert got == want


def test_native_fold(spark, codec):
    words = sorted({w for t in texts(20) for w in t.split()} | {" the", "zqxj", "ööö", "a" * 60, "中文"})
    got = bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), codec.ranks).collect()
    assert {r["word"]: le(r["ids"]) for r in got} == {w: codec.word(w) for w in words}


def check_packing(rows, docs, capacity, encode):
    """Every document cut as it should be, every sequence gapless and within capacity; returns the number of sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, t in docs:
        ids = encode(t or "") + [1]
        want[i] += [(k, s, len(ids[s:s + capacity]), zlib.crc32(le(ids[s:s + capacity]))) for k, s in enumerate(range(0, len(ids), capacity))]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pack(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    encode = lambda t: library.encode(t, add_special_tokens=False).ids                                 # noqa: E731
    for extra, capacity in ((False, 64), (True, 4096)):
        docs = documents(spark, extra)
        rows = packing.pack(docs, P.path("word_bpe_49k.json"), capacity).collect()
        n = check_packing(rows, rows_of(docs), capacity, encode)
        assert n <= -(-sum(r["length"] for r in rows) // capacity) * 1.2 + 1


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=25))
def test_plan(histogram):
    """Runs cover all pieces once and fill sequences without overlap; never more sequences than first-fit decreasing with its slack."""
    capacity, filled, numbers = 40, defaultdict(list), Counter()
    for length, first, stop, sequence, each, base in packing.plan(histogram, capacity):
        assert first == numbers[length]
        numbers[length] = stop
        for i in range(stop - first):
            filled[sequence + i // each].append((base + i % each * length, length))
    assert numbers == Counter(histogram)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    bins = []
    for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        at = next((i for i, room in enumerate(bins) if room >= length), None)
        if at is None:
            bins.append(capacity - length)
        else:
            bins[at] -= length
    assert len(filled) <= len(bins) * 1.25 + 1


def test_word_encoder_on_any_text():
    encoder = packing.WordEncoder(P.path("word_bpe_49k.json"))

    @settings(max_examples=500, deadline=None)
    @given(st.one_of(st.text(alphabet="abesTHIé'sSlLÀß×÷ªº12.,!<|>\n\t \u00a0\u0301İ", max_size=40), st.text(max_size=30)))
    def same(text):
        assert encoder.encode([text]) == [encoder.whole(text)]
    same()


def test_empty_tables(spark):
    none = documents(spark).limit(0)
    for df in (pii.find_pii(none), pii.redact(none), tokens.count_tokens(none, P.path("piece_bpe_32k.model"), 5),
               bpe.round_trip(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), packing.pack(none, P.path("word_bpe_49k.json"))):
        assert df.count() == 0 and df.columns
