"""A language with few rows beside one that holds most of them."""

import random

import numpy as np

from fleetgauge.llm import langid


def test_rare_language_keeps_its_entries(spark):
    r = random.Random(2)
    large = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(2000)]
    small = ["".join(r.choice("klmnopqrst") for _ in range(6)) for _ in range(40)]
    rows = [(i, " ".join(r.choice(large) for _ in range(60)), "aa") for i in range(3000)]
    rows += [(10_000 + i, " ".join(r.choice(small) for _ in range(20)), "zz") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learn(df, fit_rows=300)
    assert model.langs == ["aa", "zz"]
    own = sorted({w for _, t, lang in rows for w in t.split() if lang == "zz"})
    assert (model.rows(np.array([langid.key_of(0, w) for w in own], np.uint64)) >= 0).all()
    found = langid.predict(spark.createDataFrame(rows[-12:], df.schema), model).collect()
    assert {x["lang_pred"] for x in found} == {"zz"}


def test_shares():
    assert langid.shares({"a": 5, "b": 100, "c": 1000}, 300) == {"a": 5, "b": 100, "c": 195}
    assert langid.shares({}, 9) == {} and sum(langid.shares({"a": 9, "b": 9, "c": 9}, 10).values()) == 10
