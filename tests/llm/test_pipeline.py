import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, quality, repeats

from .helpers import AWKWARD, DOCS, docs
from .test_nearcopies import brute as near
from .test_quality import brute as counts
from .test_repeats import brute as cut_words

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
#: Names of results and of columns that operators make for themselves.
OURS = ["kept", "ratio", "N_WORDS", "reason", "rest", "n_removed", "spans", "selected", "topic", "n_tokens", "source_key", "probability", "component_id", "node", "row", "rows", "chunk", "id", "x", "sequence_id", "offset", "piece", "length", "__own_kept", "__text"]


def test_stages_take_effect(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = STAGES["quality"](spark, documents, FOLDER)
    assert first.columns == documents.columns
    texts = {r.doc_id: r.text for r in documents.collect()}
    kept = {r.doc_id for r in first.collect()}
    for i, t in texts.items():
        base = counts(t)
        assert i not in kept or base[0] >= 10 and 100 * base[4] <= 20 * base[0]
    second = STAGES["near_dedup"](spark, first, FOLDER)
    components = near([(i, texts[i]) for i in kept])
    assert {r.doc_id for r in second.collect()} == {i for i in kept if components[i] == i}
    rows = [(r.doc_id, r.text) for r in second.collect()]
    third = STAGES["repeats"](spark, second, FOLDER)
    want = cut_words(rows)
    got = {r.doc_id: r for r in third.collect()}
    assert set(got) == {i for i, (n, gone, _) in want.items() if not n or gone < n}
    for i, r in got.items():
        assert r.text.split() == want[i][2].split() and r.n_chars == len(r.text)
    fourth = STAGES["mixing"](spark, third, FOLDER)
    assert fourth.columns == documents.columns
    assert 0.6 * len(got) < fourth.count() <= len(got)
    last = STAGES["packing"](spark, fourth, FOLDER).toPandas()
    assert set(last.doc_id) == {r.doc_id for r in fourth.collect()}
    assert last.groupby("sequence_id").length.sum().max() <= 1024


def test_run_and_empty(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "repeats", "mixing", "packing"]
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert docs(spark, []).schema == DOCS


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_awkward_rows_with_columns_named_as_results(spark, name):
    """Each stage by itself on nulls, blanks, repeated rows and a long text, beside columns with names of ours."""
    plain = docs(spark, AWKWARD)
    full = plain.select("*", *(F.lit("own").alias(c) for c in OURS if c not in plain.columns))
    got = STAGES[name](spark, full, FOLDER)
    want = STAGES[name](spark, plain, FOLDER)
    key = lambda df: sorted(map(str, (r.doc_id for r in df.collect())))
    assert key(got) == key(want)
    if name != "packing":
        assert got.columns == full.columns
        assert all(r[c] == "own" for r in got.collect() for c in OURS if c not in plain.columns)
        assert STAGES[name](spark, full.limit(0), FOLDER).count() == 0


def test_operators_set_results_apart(spark):
    d = docs(spark, AWKWARD)
    for f, names in ((quality.compression_bands, [x.split()[0] for x in quality.SCHEMA.split(", ")]), (repeats.cut_repeats, ["n_words", "n_removed", "kept", "rest", "spans"]), (mixing.mix, ["selected", "probability"])):
        full = d.select("*", *(F.lit(7).alias(n) for n in names))
        got = f(full, keep=["doc_id", *names], prefix="__p_")
        assert all(r[n] == 7 for r in got.collect() for n in names) and {f"__p_{n}" for n in names} <= set(got.columns)
