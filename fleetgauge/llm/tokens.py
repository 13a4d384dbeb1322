"""Token counts by prefix dynamic programming over a sentence-piece BPE vocabulary with byte fallback.

For every prefix of a chunk the table holds the last token of its encoding and the exact number of tokens. The last token is the
one token `t` ending there for which merging (last token before `t`) + `t` on its own gives these two tokens back: an encoding
is right exactly if every two neighbours are. So the table answers "how many tokens has this prefix" and "which is the longest
prefix within this budget" without encoding anything again.

No merge crosses the chunks: a text is cut before every run of word-start marks, around every character that occurs in no piece but
its own, and after letters that another sign follows, if no piece of the vocabulary goes on like that. A document's prefix counts are its chunks' counts summed up, plus the table of the chunk that is cut through.
Distinct chunks are kept per worker, up to `MEMO` of them.

Null counts as empty: no tokens. Repeated rows get a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from fleetgauge.session import ship

from .common import per_batch, pick, worker_memo

MARK = "▁"
MEMO = 400_000


class PieceCounter:
    def __init__(self, model: str) -> None:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.rank = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        joined = {c for piece in self.rank if len(piece) > 1 for c in piece} - {MARK}
        pairs = {p for piece in self.rank for p in zip(piece, piece[1:])}
        letters = {c for c in joined if c.isalpha()}
        if any(a in letters and b not in letters for a, b in pairs):       # some piece goes on after a letter with another sign
            letters = set()
        some = lambda chars: f"[{re.escape(''.join(sorted(chars)))}]" if chars else "(?!)"                       # noqa: E731
        word, sign = some(letters), some(joined - letters)
        self.cut = re.compile(f"{MARK}*{sign}*{word}+|{MARK}*{sign}+|{MARK}+|[^{MARK}]")
        self.longest = max(map(len, self.rank))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, int] = {}

    def merged(self, text: str) -> list[str]:
        """The merges as trained: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stand(self, before: str, token: str) -> bool:
        """Whether `token` stays whole, and stays apart from the token before it."""
        if len(self.pairs) > MEMO:
            self.pairs.clear()
        found = self.pairs[before, token] = self.merged(before + token) == ([before, token] if before else [token])
        return found

    def prefix_counts(self, chunk: str) -> list[int]:
        """The number of tokens of chunk[:i], for every i."""
        rank, stand, known, longest = self.rank, self.stand, self.pairs.get, self.longest
        last, count = [""], [0]
        for end in range(1, len(chunk) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = chunk[start:end]
                if token in rank or end - start == 1:
                    whole = known((last[start], token))
                    if whole or whole is None and stand(last[start], token):
                        last.append(token)
                        count.append(count[start] + (1 if token in rank else len(token.encode())))
                        break
        return count

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def __getitem__(self, chunk: str) -> int:
        known = self.memo.get(chunk)
        if known is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            known = self.prefix_counts(chunk)[-1]
            if len(chunk) <= 64:
                self.memo[chunk] = known
        return known

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.chunks(text)))

    def fit(self, text: str, budget: int) -> int:
        """The most leading characters of the text that make at most `budget` tokens."""
        chunks = self.chunks(text)
        before, used, best = 0, 0, 0
        for chunk in chunks:
            whole = self[chunk]
            if used + whole <= budget:
                best = before + len(chunk)
            if used + whole >= budget:
                inside = [i for i, n in enumerate(self.prefix_counts(chunk)) if used + n <= budget]
                best = max([best, *(before + i for i in inside[-1:])])
            before, used = before + len(chunk), used + whole
            if used > budget:
                break
        return max(0, best - 1)      # the mark that every text starts with is not one of its characters


COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, chars_within_limit bigint"


def count_tokens(docs: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: bytes, tokens, whether there are more than `limit`, and how many leading characters keep within it.

    `model` is the path of the vocabulary file on the executors.
    """
    def make():
        counter = worker_memo(f"pieces {model}", lambda: PieceCounter(model))

        def work(batch):
            texts = batch.column("text").to_pylist()
            counts = [counter.count(t) for t in texts]
            return {"doc_id": batch.column("doc_id"), "n_bytes": pc.cast(pc.binary_length(batch.column("text")), pa.int64()),
                    "n_tokens": counts, "over_limit": [n > limit for n in counts],
                    "chars_within_limit": [len(t) if n <= limit else counter.fit(t, limit) for t, n in zip(texts, counts)]}
        return work
    return per_batch(pick(docs, id_col, text_col), make, COUNTS)


PREFIXES = "doc_id bigint, ends array<int>, counts array<int>"


def prefix_table(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the character positions at which chunks end, and the token count of the prefix up to each.

    Within a chunk, `PieceCounter.prefix_counts` has the count at every character.
    """
    def make():
        counter = worker_memo(f"pieces {model}", lambda: PieceCounter(model))

        def work(batch):
            ends, counts = [], []
            for text in batch.column("text").to_pylist():
                at, used, e, c = -1, 0, [], []
                for chunk in counter.chunks(text):
                    at, used = at + len(chunk), used + counter[chunk]
                    e.append(at)
                    c.append(used)
                ends.append(e)
                counts.append(c)
            return {"doc_id": batch.column("doc_id"), "ends": pa.array(ends, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int32()))}
        return work
    return per_batch(pick(docs, id_col, text_col), make, PREFIXES)


ship(__name__)
