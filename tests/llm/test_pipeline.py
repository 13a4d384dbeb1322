"""The pipeline against a plain version of every stage."""

from collections import defaultdict

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from fleetgauge.llm import langid, pii

from .test_near import plain_kept
from .test_text import check_packing


def plain_run(spark, sf_dir):
    """(doc_id, text) of the documents that reach packing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scorer = langid.Scorer(langid.learn(docs.filter(~langid.held_out())))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if scorer.predict(t or "")[1] >= corpus_pipeline.MIN_CONFIDENCE}
    groups = defaultdict(list)
    for i, t in rows.items():
        groups["".join(c for c in t if c not in " \t\n\v\f\r")].append((-len(t), i))
    rows = {i: rows[i] for i in (min(g)[1] for g in groups.values())}
    kept = {i for _, i in plain_kept(list(rows.items()))}
    assert len(kept) < len(rows)
    return [(i, pii.masked(t)) for i, t in rows.items() if i in kept]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    wanted = plain_run(spark, sf_dir)
    check_packing(rows, wanted, 4096, lambda t: library.encode(t, add_special_tokens=False).ids)
    assert 100 < len(wanted) < 200
