"""Every stage of the pipeline on what the stage before it kept, against brute force."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from motifmill.llm import decontaminate, mixing, quality

from . import brute
from .test_text_operators import odd_rows, table

DATA = "/root/testdata/sf0.001"


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("uid", F.lit("extra"))
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_duplicates", "repeated_passages", "decontamination", "source_mix"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], DATA).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    rows = [sorted((r.doc_id, r.text, r.n_chars) for r in t.collect()) for t in tables]
    assert all(t.columns == columns for t in tables[:-1]) and tables[-1].columns == [*columns, "mix_copies"]

    # plain votes and label model; the scorer, which has a test of its own, may only turn what they leave open
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    texts = {i: t for i, t, _ in rows[0]}
    known = brute.lexicon([texts[i] for i in labels if i in texts], [labels[i].toxic == 1 for i in labels if i in texts])
    posterior = dict(zip(texts, brute.label_model([brute.votes(t, known) for t in texts.values()]), strict=True))
    kept = {i for i, _, _ in rows[1]}
    judged = {r.doc_id: r for r in quality.classify(docs, labelled=spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    for i, p in posterior.items():
        assert judged[i].posterior == pytest.approx(p, abs=1e-5)
        assert (i in kept) == bool(texts[i] and texts[i].split() and p * judged[i].score >= (1 - p) * (1 - judged[i].score)) or abs(judged[i].quality - 0.5) < 1e-4
    clean = {i for i, r in labels.items() if r.quality and not r.toxic}
    assert len(clean & kept) >= 0.98 * len(clean) and not any(labels[i].quality == 0 for i in kept & set(labels))

    groups = brute.near_groups([t for _, t, _ in rows[1]], 80)
    assert rows[2] == [r for k, (r, (_, g)) in enumerate(zip(rows[1], groups, strict=True)) if g == k]

    cut = brute.removed_words([t for _, t, _ in rows[2]], 20)
    assert [(i, t.encode().split(), n) for i, t, n in rows[3]] == [(i, [x for x, g in zip(w, gone, strict=True) if not g], len(rows[3][k][1])) for k, ((i, _, _), (w, gone)) in enumerate(zip(rows[2], cut, strict=True))]

    items = [x for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if (x := decontaminate.normalised(r.text))]
    assert min(map(len, items)) >= decontaminate.LEAST_ITEM
    budgets = [decontaminate.edit_budget(len(x)) for x in items]
    clean = [r for r in rows[3] if all(e > b for e, b in zip(brute.least_edits_of_all(items, decontaminate.normalised(r[1])), budgets, strict=True))]
    assert rows[4] == clean

    frame = tables[4].toPandas()[["doc_id", "text", "source"]]  # noqa: F841
    c = duckdb.connect()
    c.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, source FROM frame")
    taken = {i: t // n for i, n, _, _, t in c.execute(mixing.MIX_SQL).fetchall() if t}
    assert {r.doc_id: r.mix_copies for r in tables[-1].collect()} == taken


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null and repeated ids, repeated rows, null texts, columns with clashing names, and no rows at all."""
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = [*odd_rows(), (8, "word " * 5000), (11, "")]
    for k, docs in enumerate((table(spark, rows), table(spark, rows).limit(0))):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        docs, before = spark.read.parquet(f"{tmp_path}/{k}/documents.parquet"), docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(f"{tmp_path}/{k}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}/{name}")
            assert docs.columns[: len(before)] == before
        got = docs.collect()
        assert {r.text for r in got} <= {t for _, t in rows} | {r.text for r in got if r.text and any(t and r.text.split()[0] in t for _, t in rows)}
        assert all(r.text.split() and r.mix_copies in (1, 2) for r in got) and (k or len({r.text for r in got}) == len(got))
    assert not got


def test_run_writes_between_stages(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns[-1] == "mix_copies" and 100 < got.count() < 200
    assert pd.Series([r.mix_copies for r in got.collect()]).between(1, 2).all()
