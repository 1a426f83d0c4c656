import __spark_entry__ as entry
import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from test_near_duplicates import kept_by_all_pairs
from test_tokens import check_packing

from sourceloom.llm import quality_rules, toxicity
from sourceloom.llm.common import tokenizer_path
from sourceloom.llm.packing import load_tokenizer


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        seen.append(name)
        if name == "quality_rules":
            good = {r.doc_id for r in quality_rules.quality_measures(spark.createDataFrame(before)).where("kept").collect()}
            assert {r.doc_id for r in after} == good
        elif name == "near_duplicates":
            assert sorted(r.doc_id for r in after) == kept_by_all_pairs(before)
        elif name == "packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert seen == ["quality_rules", "toxicity", "near_duplicates", "packing"]


def test_stages_take_empty_and_odd_rows(spark, sf_dir, edge_docs, empty_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs, sf_dir).count() == 0
    kept = {name: stage(spark, edge_docs, sf_dir) for name, stage in corpus_pipeline.STAGES}
    assert kept["quality_rules"].columns == kept["toxicity"].columns == kept["near_duplicates"].columns == edge_docs.columns
    assert kept["quality_rules"].collect() == []
    assert kept["toxicity"].count() == edge_docs.count()
    texts = [r.text for r in kept["near_duplicates"].collect()]
    assert len(texts) == len(set(texts)) == 11 and sum(not (t or "").strip() for t in texts) == 1
    placed = {(r.doc_id, r.doc_tokens) for r in kept["packing"].collect()}
    assert {d for d, _ in placed} == {r.doc_id for r in edge_docs.collect()} and (0, 1) in placed and (None, 1) in placed


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{k}" for k in range(1, 14)} and "pipeline" in entry.queries()


def test_workers_give_up_words_after_packing(spark, sf_dir):
    """Later stages use the same workers and need the room."""
    path = tokenizer_path("word_bpe_49k.json")
    corpus_pipeline.packing(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).count()

    def kept(batches):
        for _ in batches:
            pass
        memory = load_tokenizer(path).memory
        yield pa.RecordBatch.from_arrays([pa.array([len(memory.young) + len(memory.old)])], names=["n"])

    assert {r.n for r in spark.range(0, 8, 1, 4).mapInArrow(kept, "n long").collect()} == {0}


def test_documents_reach_workers_in_bounded_batches(spark, sf_dir):
    docs = spark.range(0, 24, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200_000).alias("text"))
    corpus_pipeline.toxicity(spark, docs.limit(1), sf_dir)

    def sizes(batches):
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes for b in batches])], names=["n"])

    found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 24_000_000 and max(found) <= 2 * corpus_pipeline.BATCH_BYTES
