"""The pipeline's stages keep columns and take effect; its queries are registered."""

import __spark_entry__
import corpus_pipeline
from solvara.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x[: x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5 and set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9002, "", "en", "s", 0)], docs.schema)
    docs, columns = docs.unionByName(extra), docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns, name
        out = corpus_pipeline.materialize(out, name)
        counts.append((docs.count(), out.count()))
        docs = out
    toxic, near, leaks, _ = counts
    assert toxic[0] > toxic[1] > 0.7 * toxic[0] and near[0] > near[1] > 0.7 * near[0] and leaks[0] > leaks[1] > 0.7 * leaks[0]
    shards = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sum(x.n_slots for x in shards) >= docs.count()


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_documents_go_through_every_stage(spark):
    # clashing columns, one very long text, many repeated rows, null everything
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    names = ("score", "slot", "taken", "n_hit", "set_key", "hash", "__text")
    clash = lambda df: df.selectExpr("*", *(f"'x' AS {n}" for n in names))
    odd = [(9001, "word " * 150_000, "en", "s", 0), (None, None, None, None, None), (9003, "", None, "s", 0)] + [(9002, "the very same words stand in each of these rows of one id", "en", "hot", 0)] * 900
    docs = clash(docs.unionByName(spark.createDataFrame(odd, docs.schema)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, FOLDER), name)
        assert out.columns == docs.columns and out.where("score <> 'x'").count() == 0, name
        if name == "near_duplicates":
            assert out.where("doc_id = 9002").count() == 1 and out.where("doc_id IN (9001, 9003)").count() == 2
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() > 0
