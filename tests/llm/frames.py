"""Small documents with every awkward case, and rows that brute force can check."""

import random

from pyspark.sql import functions as F

AWKWARD = [
    None, "", " ", "\n\t \r", "a", "a b", "one two three", "One TWO three", "ONE two Three", "é ü ß ñ Ç", "İstanbul ſ K 中文 字 ² ½ Ⅷ",
    "x" * 70_000, "ab " * 30_000, "a" * 300 + " " + "b" * 40, "tabs\tand\vfeeds\fhere\u0085\u00a0\u2003end", "e\u0301 combining", "<s> <|endoftext|> </s> <unk>",
    "it's we'll I'm THEY'RE 'sample .'s ''d", "1234567890 1.2.3.4 999.1.1.1 00001.2.3.4", "▁marks ▁▁ here", "   leading and   runs    ", "trailing   ",
    "mail me at a.b+c@example.com, or x@y, or @z.w, a@b.c@d.e.f", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 41111111111111111111111",
    "call +1 (212) 555-0100 now, +12, +1234567890123456", "IBAN DE89 3704 0044 0532 0130 00, DE89370400440532013001", "😀 emoji 👩\u200d👩 zero\u0000byte \x1c\x1d",
]


def texts(n=120, seed=7):
    """Invented prose with exact copies, copies but for white space or a word, and passages that repeat."""
    r = random.Random(seed)
    words = ["the", "river", "and", "mountain", "sings", "over", "quiet", "fields", "der", "und", "Straße", "über", "Häuser", "garçon", "était", "niño", "está"]
    made = [" ".join(r.choice(words) for _ in range(r.randint(30, 200))) for _ in range(n // 2)]
    while len(made) < n:
        t = r.choice(made)
        kind = r.randrange(4)
        if kind == 1:
            t = t.replace(" ", "  ", 2)
        elif kind == 2:
            t += " " + r.choice(words)
        elif kind == 3:
            t = t.replace("the", "The", 1)
        made.append(t)
    return made


def documents(spark, extra=False):
    """(doc_id, text, lang, source, n_chars), with repeated rows and, if asked for, columns that clash with names used inside."""
    langs = ["en", "de", "fr", None]
    rows = [(i, t, langs[i % 4], f"s{i % 3}", len(t or "")) for i, t in enumerate(AWKWARD + texts())]
    rows += [rows[30], rows[31], (None, "no id at all", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    if extra:
        for name in ("fp", "half", "key", "group", "rid", "digit", "payload", "spans", "ids", "length", "number", "n", "u", "v", "votes", "Score", "a.b"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
