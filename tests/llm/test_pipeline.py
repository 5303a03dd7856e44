
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellweave.llm import exprs, quality, queries, similar
from tests.llm.helpers import AWKWARD, documents
from tests.llm.test_secrets_omh import plain_spans
from tests.llm.test_simhash import brute_groups, plain_fingerprint


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    named = dict(corpus_pipeline.STAGES)

    good = named["quality classifier"](spark, docs, sf_dir).cache()
    scores = {r.doc_id: r.predicted for r in quality.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p}

    lines = named["line dedup"](spark, good, sf_dir).cache()
    assert lines.columns == columns and lines.count() == good.count()
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = named["simhash near-dedup"](spark, lines, sf_dir).cache()
    kept = {r.doc_id for r in near.collect()}
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in lines.select("doc_id", "text").collect()]
    groups = {}
    for (i, _), g in zip(prints, brute_groups(prints), strict=True):
        groups.setdefault(g, []).append(i)
    assert all(len(kept & set(g)) <= 1 for g in groups.values())
    texts = {r.doc_id: r.text.encode() for r in lines.select("doc_id", "text").collect()}
    shingled = {i: set(similar.shingles(similar.words(t))) for i, t in texts.items()}

    def alike(i, j):
        a, b = shingled[i], shingled[j]
        return 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and (9 * len(a & b) >= 4 * (len(a) + len(b)))

    # nothing similar to each other is kept, and what went was connected to something smaller
    assert not any(alike(i, j) for i in kept for j in kept if i < j)
    assert all(any(alike(i, j) for j in texts if j != i) for i in texts.keys() - kept)
    assert near.columns == columns and len(kept) == near.count()

    masked = named["secret scans"](spark, near, sf_dir).cache()
    assert masked.columns == columns and masked.count() == near.count()
    assert not any(plain_spans(r.text)[0] for r in masked.collect())

    packed = named["best-fit packing"](spark, masked, sf_dir)
    assert {r.doc_id for r in packed.collect()} == kept


def test_run_applies_all_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    pick = lambda f: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in f.collect())
    assert pick(out) == pick(docs)
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("rows", [[], AWKWARD, [(None, None)]], ids=["empty", "awkward", "nulls"])
def test_stages_take_awkward_tables(spark, sf_dir, rows):
    docs = documents(spark, rows)
    judged = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert judged.columns == docs.columns and judged.count() <= len(rows)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() <= len(rows)
        docs = out
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()} == {r.doc_id for r in docs.collect()}


def test_every_query_is_registered_and_covers_its_table(spark, sf_dir):
    import __spark_entry__

    every = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in every) for k in range(1, 14)] == [1] * 13 and "pipeline" in every
    documents_ = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in queries.queries():
        if name.startswith("op") and name not in ("op7_hnsw_search", "op9_best_fit_packing", "op11_vector_codes", "op12_itq_near_dedup", "op13_conversation_repair"):
            assert every[name](spark, sf_dir).count() == documents_, name


def test_quality_stage_sends_few_texts_at_once(spark, sf_dir):
    """Files of 10,000 texts in one batch took an executor over its memory; and slices of a batch lose no row."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).select(F.col("text"))
    docs = documents(spark, []).select("doc_id", "lang", "source", "n_chars")
    many = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    rows = text.withColumn("at", F.monotonically_increasing_id() % 20).groupBy("at").agg(F.min("text").alias("text"))
    docs = docs.unionByName(many).withColumn("at", F.col("doc_id") % 20).join(F.broadcast(rows), "at").drop("at").coalesce(1).cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    try:
        spark.conf.set(name, "10000")
        wanted = {r.doc_id for r in quality.score_documents(docs, labels).filter("predicted = 1").collect()}
        assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == wanted and wanted
        assert spark.conf.get(name) == "10000"
        kept = corpus_pipeline.quality_filter(spark, docs, sf_dir)
        assert int(spark.conf.get(name)) == exprs.TEXTS
        assert {r.doc_id for r in kept.collect()} == wanted
        spark.conf.set(name, "7")
        corpus_pipeline.quality_filter(spark, docs, sf_dir)
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.set(name, before)
        docs.unpersist()
