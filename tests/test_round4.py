"""What round 4 found: capitals of single letters, joins whose sides only look small, search and extraction in bounded pieces."""

from pyspark.sql import functions as F

from sourceloom.functions import text as T


def test_a_sentence_begins_with_one_capital_letter(spark):
    import duckdb

    from sourceloom.queries_text import ORACLES

    rows = [(4 * k + 3, f"{c} and the rest of a text that is long enough") for k, c in enumerate("aäßŉǰΐᾀᾈᾳῃῴﬁﬀև1 -")] + [(1, "function x"), (3, "ß"), (0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    found = docs.select("doc_id", T.strip_subject(F.concat(F.when(F.col("doc_id") % 4 == 0, "The function `f` ").when(F.col("doc_id") % 4 == 1, "method `g` method ").otherwise(""), "text")).alias("rest"))
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(ORACLES["strip_subject"]).fetchall())


def test_edges_never_broadcast_tables_of_names(spark, tmp_path):
    from sourceloom.operators import graph

    rows = [("r", f"p{k}.py", 0, "Python", f"call_{k}", f"call_{k}", "function", f"def call_{k}()", [f"call_{k + 1}"]) for k in range(9)]
    columns = "repo string, path string, pos int, language string, name string, short_name string, symbol_type string, signature string, called_names array<string>"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    calls = chunks.select("repo", "path", "pos", F.col("name").alias("caller"), F.lit(1).alias("line"), F.lit(0).alias("ord"), F.element_at("called_names", 1).alias("called"))
    for found in (graph.call_edges(chunks), graph.hot_callees(calls, chunks)):
        assert found.count() == 8
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_search_within_a_group_shuffles_no_row_for_each_pair_of_blocks(spark):
    """Vectors are repeated for blocks of queries alone, and a query brings home its best of few slices, however many blocks of vectors there are."""
    from sourceloom.operators.related import nearest_within

    rows = spark.range(640).select(F.lit("r").alias("repo"), "id", F.array(F.cos("id"), F.sin("id")).alias("vector"))
    found = nearest_within(rows.where("id < 4"), rows, "repo", 3, 4)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 12 and "FlatMapCoGroups" not in text and "MapInArrow" in text


def test_best_of_many_equal_and_odd_vectors():
    import numpy as np

    from sourceloom.operators.related import _Best

    random = np.random.default_rng(3)
    vectors = random.integers(0, 3, (5000, 4)).astype(float)
    vectors[::7] = [1.0, 2.0, 0.0, 1.0]
    vectors[4999] = [np.nan, 1.0, 1.0, 1.0]
    ids, queries = random.permutation(5000), random.integers(0, 3, (300, 4)).astype(float)
    best = _Best(np.arange(300), queries, 9)
    for start in range(0, 5000, 700):
        best.meet(ids[start : start + 700], vectors[start : start + 700])
    with np.errstate(invalid="ignore"):
        scores = np.nan_to_num(queries @ vectors.T, nan=-np.inf)
    for q in range(300):
        assert best.id[q].tolist() == [i for _, i in sorted(zip(-scores[q], ids))[:9]]
    few = _Best(np.arange(2), queries[:2], 9)
    few.meet(np.array([5, 3]), np.array([[1.0, 1.0, 1.0, 1.0], [np.nan, 0.0, 0.0, 0.0]]))
    assert few.id[0].tolist()[:2] == [5, 3]


def test_near_ties_go_by_id_across_blocks(spark):
    """Scores that agree in nine places are ties wherever they are found: the smaller id comes first, as in the SQL."""
    from sourceloom.operators.related import nearest_within

    kind = "repo string, id long, vector array<double>"
    rows = [("r", k, [1.0 + (40 - k) * -1e-11]) for k in range(40)]
    found = nearest_within(spark.createDataFrame([("r", 0, [1.0])], kind), spark.createDataFrame(rows, kind), "repo", 3)
    assert [r.id for r in found.orderBy("place").collect()] == [0, 1, 2]


def _bytes_below(folder):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_the_graph_of_files_stores_no_sources(spark, sf_dir):
    from sourceloom import queries
    from sourceloom.plans.code_view import code_files
    from sourceloom.scratch import shared_folder

    size = code_files(spark, sf_dir).agg(F.sum(F.length("content"))).first()[0]
    before = _bytes_below(shared_folder(spark))
    queries.QUERIES["core_files"](spark, sf_dir).collect()
    assert _bytes_below(shared_folder(spark)) - before < size / 5


def test_calls_of_odd_line_items(spark, tmp_path):
    """Repeated calls count once, in a loop if any is; parts that do not exist call nothing and are not called."""
    from sourceloom.plans.code_view import code_files

    spark.createDataFrame([(0,), (1,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(0, 3), (1, 3), (2, 3), (20, 3)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    items = [(1, 0, "N"), (1, 20, "N"), (2, 0, "R"), (2, 20, "N"), (3, 0, None), (3, 2, "N"), (4, 0, "N"), (4, 99, "N"), (5, 99, "N"), (5, 2, "N"), (6, None, "N"), (6, 1, "N"), (7, 0, "N"), (7, 0, "N")]
    rows = [(order, place, part, 0, 0.0, 0.0, flag) for place, (order, part, flag) in enumerate(items)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    text = {r.path: r.content for r in code_files(spark, str(tmp_path)).collect()}["repo/d0/m0.py"]
    assert text.split("def fn_0_1(a, x):\n")[1].split("\n\n")[0].split("\n")[:5] == ["    pass", "    fn_0_1(x)", "    fn_2_1(x)", "    for i in a:", "        fn_18_3(i)"]


def test_files_reach_extraction_in_bounded_batches(spark):
    from sourceloom.sources import extract

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    text = "def f(x):\n    return g(x)\n\n" * 20_000
    files = spark.range(0, 6, 1, 1).select(F.lit("r").alias("repo"), F.concat("id", F.lit(".py")).alias("path"), F.lit(text).alias("content"), F.lit("Python").alias("language"))
    found = extract.extract(files)
    assert int(spark.conf.get(name)) <= 4 << 20
    assert [r.n for r in found.select(F.size("chunks").alias("n")).collect()] == [20_000] * 6


def test_facts_of_files_are_joined_by_sorting(spark, sf_dir):
    from sourceloom import queries_code

    queries_code._BUILT.clear()
    found = queries_code._facts(spark, sf_dir)
    assert found.count() > 0 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
