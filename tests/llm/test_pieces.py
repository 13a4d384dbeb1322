"""SentencePiece chunks against the library."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece

from fleetgauge.llm import pieces

from .frames import AWKWARD, documents, rows_of

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_fuzz(library):
    r = random.Random(1)
    parts = [" ", "  ", "▁", "a", "the", "ing", "\n", "\t", "é", "中", "文", "①", "😀", "\x00", "<s>", "</s>", "<unk>", "<0x41>", "0", "12", ".", "?", "ﬁ", "İ"]
    made = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    made += ["".join(chr(r.choice([r.randrange(1, 0x250), r.randrange(0xe000, 0x110000)])) for _ in range(r.randint(1, 40))) for _ in range(1000)]
    made += [t or "" for t in AWKWARD] + ["ab" * 20_000, "中" * 20_000, " " * 20_000]
    own = pieces.Pieces(MODEL)
    for text in made:
        ids = library.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids) == own.round_trip(text)[1]
    for _ in range(2000):
        ids = [r.choice([r.randrange(300), r.randrange(32_000)]) for _ in range(r.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids)


def test_long_and_short_merges_agree():
    own, r = pieces.Pieces(MODEL), random.Random(3)
    for _ in range(2000):
        chunk = "▁" + "".join(r.choice("aeinrst") for _ in range(r.randint(0, 30)))
        assert own.merged_long(chunk) == own.merged_short(chunk)


@pytest.mark.parametrize("memo", [250_000, 5])
def test_digests(spark, library, monkeypatch, memo):
    monkeypatch.setattr(pieces, "MEMO", memo)
    for extra in (False, True):
        docs = documents(spark, extra)
        want = Counter()
        for i, text in rows_of(docs):
            ids = library.encode(text or "")
            want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
        assert Counter(map(tuple, pieces.digests(docs, MODEL).collect())) == want
    assert pieces.digests(docs.limit(0), MODEL).count() == 0


def test_encode_and_decode_tables(spark, library):
    docs = documents(spark)
    encoded = pieces.encode(docs, MODEL)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == Counter((i, tuple(library.encode(t or ""))) for i, t in rows_of(docs))
    back = pieces.decode(encoded, MODEL)
    assert Counter(map(tuple, back.collect())) == Counter((i, library.decode(library.encode(t or ""))) for i, t in rows_of(docs))


def test_other_normalisation_is_refused(tmp_path):
    with pytest.raises((ValueError, OSError, RuntimeError)):
        pieces.Pieces(str(tmp_path / "none.model"))
