"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Every span is (kind, start, end, score) with code point offsets and an exclusive end. The base kinds (email, ip, card, phone)
are reported whenever pattern and check agree; their score says how sure the words around make us. The kinds that the method
adds (iban, ssn, local_phone) are reported at a score of `MIN_SCORE` or more. All patterns take time in proportion to the text:
possessive runs never give back, and an address grows leftwards from its "@" no further than the match before.

Null and empty texts have no spans. Repeated rows each get their own row. An empty table gives an empty result with the same
columns. Other columns of the input are not read by `find_pii`; `redact` hands them on unchanged.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from fleetgauge.session import ship

from .common import map_rows, per_batch, pick

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE = 4
MIN_SCORE = 0.5
CONTEXT_CHARS = 48

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
NOT_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"[a-z]+")

# Words near a span that speak for its kind, and words that speak against any kind.
FOR = {
    "email": {"email", "mail", "contact", "write", "address"},
    "ip": {"ip", "host", "server", "address", "login"},
    "card": {"card", "credit", "debit", "visa", "mastercard", "payment"},
    "phone": {"phone", "tel", "telephone", "call", "fax", "mobile", "telefon"},
    "iban": {"iban", "bank", "account", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security"},
    "local_phone": {"phone", "tel", "telephone", "call", "fax", "mobile", "telefon"},
}
AGAINST = {"version", "serial", "isbn", "order", "invoice", "sample", "test"}
# What pattern and check alone are worth.
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "local_phone": 0.4}


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if place % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str):
    """Leftmost matches: the run of address characters before each "@" that a dotted domain follows."""
    after = 0
    for m in DOMAIN.finditer(text):
        at = start = m.start()
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            after = m.end()
            yield start, after


def proposals(text: str):
    """(kind, start, end) of all spans whose check holds."""
    for a, b in emails(text):
        yield "email", a, b
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text):
        if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        compact = m[0].replace(" ", "")
        if 15 <= len(compact) <= 34 and mod97(compact):
            yield "iban", m.start(), m.end()
    for m in SSN.finditer(text):
        yield "ssn", m.start(), m.end()
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end()


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """All reported spans, by kind as listed in KINDS, then by start."""
    found = []
    for kind, a, b in proposals(text):
        near = set(WORD.findall((text[max(0, a - CONTEXT_CHARS):a] + " " + text[b:b + CONTEXT_CHARS]).lower()))
        score = START[kind] + 0.2 * bool(near & FOR[kind]) - 0.2 * bool(near & AGAINST)
        score = round(min(1.0, max(0.0, score)), 2)
        if KINDS.index(kind) < BASE or score >= MIN_SCORE:
            found.append((kind, a, b, score))
    return found


def masked(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, end = [], 0
    for kind, a, b, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


SPANS = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the hash of the base spans, all spans and their scores."""
    def make():
        def work(batch):
            out = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores")}
            for text in batch.column("text").to_pylist():
                found = spans(text)
                kinds = [s[0] for s in found]
                for kind in KINDS[:BASE]:
                    out[f"n_{kind}"].append(kinds.count(kind))
                named = [f"{k}:{a}:{b}" for k, a, b, _ in found]
                base = sum(k in KINDS[:BASE] for k in kinds)
                out["base_sha256"].append(hashlib.sha256(",".join(named[:base]).encode()).hexdigest())
                out["spans"].append(",".join(named))
                out["scores"].append(",".join(f"{s:.2f}" for *_, s in found))
            return out | {"doc_id": batch.column("doc_id")}
        return work
    return per_batch(pick(docs, id_col, text_col), make, SPANS)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`, with personal data in `text_col` replaced by its kind. A null text stays null."""
    def make():
        def work(batch, at):
            clean = [None if t is None else masked(t) for t in batch.column(at).to_pylist()]
            return batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))
        return work
    return map_rows(docs, make, text_col)


ship(__name__)
