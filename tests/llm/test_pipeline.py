"""The registered queries of the package and the pipeline."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.oracle import connect, differences

NAMES = sorted(n for n in entry.queries() if n[:2] == "op" and n[2].isdigit())


def test_all_of_them():
    assert {int(n[2:].split("_")[0]) for n in NAMES} == set(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_oracles(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert differences(entry.queries()[name](spark, sf_dir), connect(sf_dir), entry.oracle_sql()[name]) == ""


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, bench = docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    from shelf.llm import exact, minhash, tiling
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, sf_dir).collect(), docs.schema)
        assert after.columns == docs.columns and 0 < after.count() <= before.count(), name
        before = after
    assert exact.exact_groups(before).where("NOT kept").count() == 0
    assert minhash.near_components(before, 0.8).where("NOT kept").count() == 0
    assert tiling.contaminated_pairs(before, bench).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}


def test_stages_drop_what_the_last_one_left(spark, docs_of):
    first = docs_of([(1, "a b"), (2, "a  b"), (3, "c")])
    kept = corpus_pipeline.drop_copies(spark, first, "")
    rows, folders = kept.collect(), [w.folder for w in corpus_pipeline._last]
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = lambda f: path(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(f))
    assert sorted(r.doc_id for r in rows) == [1, 3] and folders and all(map(there, folders))
    corpus_pipeline.pack(spark, spark.createDataFrame(rows, first.schema), "").collect()
    assert not any(map(there, folders))


def test_run_of_defined_cases(spark, tmp_path):
    """Null and empty texts, ties, repeated rows, null ids and further columns; then empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, score double"
    words = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None), (2, ""), (3, "a  b"), (4, "a b"), (5, words), (6, words + " end"), (5, words), (None, "no id"), (7, "other text")]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2.0) for i, t in rows], schema).write.parquet(str(tmp_path / "a/documents.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "b/documents.parquet"))
    for name in "ab":
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / f"{name}/labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / f"{name}/benchmark.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in packed) == [(False, 1), (False, 3), (False, 5), (False, 7), (True, 0)]
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
