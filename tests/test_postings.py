"""Term counts and stored blocks: how their rows move, and blocks that batches of rows cut."""

from pyspark.sql import functions as F

from fathom.operators import blocks
from fathom.operators import retrieval as R
from fathom.plans import ingest
from fathom.plans.retrieval import build_index
from fathom.sinks import store, versioned


def docs(spark, n=300):
    return spark.range(n).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("own"), "id"), F.concat(F.lit("some"), F.col("id") % 7)).alias("content"))


def test_terms_are_counted_where_they_are_made(spark):
    """One exchange of texts by key, none of the terms; rows of one key and length are one document's, as before."""
    twice = docs(spark).unionByName(docs(spark, 1))
    found = R.term_counts(twice)
    rows = {(r["chunk_id"], r["term"]): r["tf"] for r in found.collect()}
    assert rows[(0, "common")] == 2 and rows[(0, R.WHOLE)] == 2 and rows[(5, "some5")] == 1 and len(rows) == 1200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" in plan and "dl#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_terms_of_queries_are_picked_where_they_are_made(spark, tmp_path):
    spark.createDataFrame([("common",), ("own5",)], "term string").write.parquet(f"{tmp_path}/only")
    found = R.term_counts(docs(spark), only=spark.read.parquet(f"{tmp_path}/only"))
    assert sorted((r["term"], r["n"]) for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()) == [("", 300), ("common", 300), ("own5", 1)]
    moved = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert sum("hashpartitioning(chunk_id" in x for x in moved) == 1 and not any("dl#" in x for x in moved)


def test_rare_terms_are_weighed_as_frequent_ones(spark, monkeypatch):
    rows = lambda index: sorted((r["term"], r["chunk_id"], round(r["weight"], 9)) for r in index.weights.collect())
    all_sent = rows(build_index(docs(spark)))
    monkeypatch.setattr(R, "SENT", 100)
    index = build_index(docs(spark))
    assert rows(index) == all_sent and len(all_sent) == 900


def test_a_block_cut_by_batches_is_one(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index = blocks.build(docs(spark), str(tmp_path))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = index.blocks
    assert rows.count() == rows.select("term", "shard").distinct().count()
    assert rows.agg(F.sum(F.size("keys"))).first()[0] == 900
    assert rows.where("abs(top - array_max(weights)) > 0 OR size(keys) <> size(weights)").isEmpty()


def test_all_blocks_of_a_shard_lie_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "SHARD", 16)
    rows = blocks.build(docs(spark), str(tmp_path)).blocks.select("shard", F.input_file_name().alias("file")).distinct().groupBy("shard").agg(F.count("*").alias("files"))
    assert rows.count() > 10 and rows.where("files > 1").isEmpty()


def shuffled(spark):
    """Rows that the session's stages have shuffled so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_neither_postings_nor_pairs_of_queries_and_documents_are_shuffled(spark, tmp_path):
    """Storing shuffles documents and each task's vocabulary; searching, blocks and the best of each shard, whatever the number of queries."""
    words = F.concat_ws(" ", F.lit("common"), F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("word"), F.pmod(F.xxhash64("id", i), F.lit(500)))))
    corpus = spark.range(4000).select(F.col("id").alias("chunk_id"), words.alias("content"))
    before = shuffled(spark)
    index = blocks.build(corpus, str(tmp_path))
    stored = shuffled(spark) - before
    assert index.blocks.agg(F.sum(F.size("keys"))).first()[0] > 140_000 and stored < 20_000
    asked = spark.range(100).select(F.col("id").alias("query_id"), F.concat(F.lit("common word"), "id").alias("text"))
    before = shuffled(spark)
    found = blocks.search(index, asked, 5).results.collect()
    assert len(found) == 500 and {r["rank"] for r in found} == set(range(5))
    assert shuffled(spark) - before < 100_000  # of 400,000 pairs


def test_documents_without_a_key_count_and_are_not_found(spark, tmp_path):
    corpus = docs(spark).unionByName(spark.createDataFrame([(None, "common rare"), (None, "rare")], "chunk_id long, content string"))
    index = blocks.build(corpus, str(tmp_path))
    assert index.stats.first()["num_docs"] == 302 and index.terms.where("term = 'rare'").first()["df"] == 2
    asked = spark.createDataFrame([(1, "rare own5")], "query_id long, text string")
    assert [r["chunk_id"] for r in blocks.search(index, asked, 3).results.collect()] == [5]


def test_a_block_knows_its_greatest_weight_by_any_mean_length(spark, tmp_path):
    """Documents of many lengths and counts: top is the greatest weight, though only the best pairs of both are kept beside the block."""
    text = F.concat_ws(" ", F.array_repeat(F.lit("common"), (1 + F.pmod(F.xxhash64("id"), F.lit(9))).cast("int")), F.array_repeat(F.lit("other"), (1 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50))).cast("int")))
    index = blocks.build(spark.range(700).select(F.col("id").alias("chunk_id"), text.alias("content")), str(tmp_path))
    for avgdl in (index.avgdl, 1.0, 1e6):
        top, most = blocks._top(avgdl), F.array_max(blocks._weights(avgdl))
        assert index.postings.count() > 4 and index.postings.where(top != most).isEmpty()
    assert index.postings.agg(F.sum(F.size("best"))).first()[0] < index.postings.agg(F.sum(F.size("keys"))).first()[0] / 5


def test_a_stored_index_has_the_weights_of_a_full_one_and_is_made_anew_in_the_new_layout(spark, tmp_path):
    table, path = f"{tmp_path}/points", f"{tmp_path}/model"
    rows = docs(spark, 60).withColumn("chunk_id", F.col("chunk_id").cast("string")).select("chunk_id", "content", F.lit("a").alias("source"), F.lit("{}").alias("metadata"))
    versioned.upsert(rows, versioned.location(spark, table), ["chunk_id"])
    weights = lambda index: sorted((r["term"], r["chunk_id"], round(r["weight"], 9)) for r in index.weights.collect())
    want = weights(build_index(rows))
    assert weights(ingest.stored_index(spark, table, path)) == want and len(want) == 180
    store.delete(spark, f"{path}/postings")  # as an index has it that was stored before
    assert weights(ingest.stored_index(spark, table, path)) == want
