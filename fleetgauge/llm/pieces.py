"""SentencePiece encoding and decoding through tables of distinct chunks.

In a vocabulary whose pieces never go on past the start of a word, no merge crosses from one marked word (its word-start marks and what
follows up to the next mark) into the next, nor over a character that occurs in no piece but its own, nor from a letter to another sign
if no piece goes on like that. So a text is cut there into chunks, each distinct chunk is merged and decoded once, and the chunks' ids and texts are joined back by position. The table of
distinct chunks belongs to a Python worker and holds at most `MEMO` of them, each of at most `SHORT` characters; what falls out is worked out
again. A vocabulary that does cross word starts is used with the whole text as one chunk.

Merges go by best score, leftmost among equals; a chunk of over `FEW` characters keeps its candidates in a heap (n log n steps). A
character without a piece becomes its UTF-8 bytes' pieces. The vocabulary has to leave texts as they are but for the word-start mark in
front and in place of spaces; another kind is refused.

Null counts as empty: no ids, and the hashes of nothing. Repeated rows get a row each, an empty table gives an empty result, a very long text
takes memory in proportion to its length, and columns other than id and text are not read, so none can clash.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re

from pyspark.sql import DataFrame

from fleetgauge.session import ship

from .common import per_batch, pick, worker_memo

MARK = "▁"
MEMO = 250_000
SHORT = 48
FEW = 24
NEVER = float("-inf")


class Pieces:
    def __init__(self, model: str) -> None:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if sp.normalize(" \ta  ① ") != "▁▁\ta▁▁①▁":
            raise ValueError(f"{model} changes more of a text than its spaces")
        self.text_of: list[str | int] = []          # a byte's piece is the number of the byte
        self.id_of: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte = int(piece[3:-1], 16)
                self.byte_id[byte] = i
                self.text_of.append(byte)
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text_of.append("" if sp.is_control(i) else " ⁇ ")
            else:
                self.id_of[piece], self.score[piece] = i, sp.get_score(i)
                self.text_of.append(piece)
        if len(self.byte_id) < 256 or MARK not in self.id_of:
            raise ValueError(f"{model} has no piece for every byte and the word-start mark")
        crossing = any(MARK in p.lstrip(MARK) for p in self.id_of)
        joined = {c for p in self.id_of if len(p) > 1 for c in p} - {MARK}
        letters = {c for c in joined if c.isalpha()}
        if any(a in letters and b in joined - letters for p in self.id_of for a, b in zip(p, p[1:])):
            letters = set()                          # some piece goes on after a letter with another sign
        letter, sign = (f"[{re.escape(''.join(sorted(chars)))}]" if chars else "(?!)" for chars in (letters, joined - letters))
        self.cut = re.compile("(?s).+" if crossing else f"{MARK}+{sign}*{letter}*|{sign}*{letter}+|{sign}+|[^{MARK}]")
        self.table: dict[str, tuple[str, str]] = {}
        codecs.register_error("byte by byte", lambda e: ("\ufffd", e.start + 1))

    def merged(self, chunk: str) -> list[str]:
        return self.merged_long(chunk) if len(chunk) > FEW else self.merged_short(chunk)

    def merged_short(self, chunk: str) -> list[str]:
        parts, score = list(chunk), self.score.get
        pairs = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == NEVER:
                break
            at = pairs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts

    def merged_long(self, chunk: str) -> list[str]:
        """The same merges; a candidate (start, middle, end) counts only while its two parts are still as they were."""
        n, score = len(chunk), self.score.get
        end_of = dict(zip(range(n), range(1, n + 1)))        # start of a part: its end
        start_of = dict(zip(range(1, n + 1), range(n)))
        heap = [(-s, i, i + 1, i + 2) for i in range(n - 1) if (s := score(chunk[i:i + 2])) is not None]
        heapq.heapify(heap)

        def propose(start, middle, end):
            s = score(chunk[start:end])
            if s is not None:
                heapq.heappush(heap, (-s, start, middle, end))

        while heap:
            _, start, middle, end = heapq.heappop(heap)
            if end_of.get(start) != middle or end_of.get(middle) != end:
                continue
            del end_of[middle], start_of[middle]
            end_of[start], start_of[end] = end, start
            if start in start_of:
                propose(start_of[start], start, end)
            if end in end_of:
                propose(start, end, end_of[end])
        return [chunk[a:b] for a, b in sorted(end_of.items())]

    def chunk_ids(self, chunk: str) -> list[int]:
        ids = []
        for part in self.merged(chunk):
            known = self.id_of.get(part)
            if known is None:
                ids += [self.byte_id[b] for b in part.encode()]
            else:
                ids.append(known)
        return ids

    def surface(self, ids: list[int]) -> str:
        """The text of a run of pieces, with word-start marks as spaces."""
        out, raw = [], bytearray()
        for i in ids:
            piece = self.text_of[i]
            if isinstance(piece, int):
                raw.append(piece)
                continue
            if raw:
                out.append(raw.decode(errors="byte by byte"))
                raw.clear()
            out.append(piece.replace(MARK, " "))
        return "".join(out) + raw.decode(errors="byte by byte")

    def row(self, chunk: str) -> tuple[str, str]:
        """The chunk's ids, in decimal with commas, and the text they stand for."""
        known = self.table.get(chunk)
        if known is None:
            ids = self.chunk_ids(chunk)
            known = ",".join(map(str, ids)), self.surface(ids)
            if len(chunk) <= SHORT:
                self.table[chunk] = known
        return known

    def rows(self, text: str) -> list[tuple[str, str]]:
        """A row for each chunk of the text, in order."""
        if not text:
            return []
        chunks = self.cut.findall(MARK + text.replace(" ", MARK))
        if len(self.table) > MEMO:
            self.table.clear()
        try:
            return [self.table[c] for c in chunks]
        except KeyError:
            return [self.row(c) for c in chunks]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.rows(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, without the mark that every text starts with."""
        lead = next((k for k, i in enumerate(ids) if self.text_of[i] != ""), None)
        marked = lead is not None and str(self.text_of[ids[lead]]).startswith(MARK)
        return self.surface(ids)[1 if marked else 0:]

    def round_trip(self, text: str) -> tuple[str, str]:
        """The ids in decimal, with commas, and the text that they decode to. Every chunk has whole characters and the first one the mark."""
        rows = self.rows(text)
        return ",".join([ids for ids, _ in rows]), "".join([part for _, part in rows])[1:]


def pieces(model: str) -> Pieces:
    return worker_memo(f"chunks {model}", lambda: Pieces(model))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per document; `model` is the path of the vocabulary file on the executors."""
    def make():
        own = pieces(model)
        return lambda batch: {"doc_id": batch.column("doc_id"), "ids": [own.encode(t) for t in batch.column("text").to_pylist()]}
    return per_batch(pick(docs, id_col, text_col), make, "doc_id bigint, ids array<int>", rows=200)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) per row of ids; null ids stand for the empty text."""
    def make():
        own = pieces(model)
        return lambda batch: {"doc_id": batch.column("doc_id"), "text": [own.decode(i or []) for i in batch.column("ids").to_pylist()]}
    rows = encoded.selectExpr(f"cast(`{id_col}` AS bigint) AS doc_id", f"cast(`{ids_col}` AS array<int>) AS ids")
    return per_batch(rows, make, "doc_id bigint, text string", rows=200)


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of ids, and the hashes of the ids (decimal, with commas) and of the decoded text (UTF-8)."""
    def make():
        own = pieces(model)

        def work(batch):
            both = [own.round_trip(t) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "n_tokens": [ids.count(",") + 1 if ids else 0 for ids, _ in both],
                    "ids_sha256": [hashlib.sha256(ids.encode()).hexdigest() for ids, _ in both],
                    "decoded_sha256": [hashlib.sha256(text.encode()).hexdigest() for _, text in both]}
        return work
    return per_batch(pick(docs, id_col, text_col), make, DIGESTS, rows=200)


ship(__name__)
