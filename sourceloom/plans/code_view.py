"""A corpus of source files written from the supplier, part and lineitem tables.

Every supplier is a file, every part a function in it, consecutive line items of an order are calls. What
extraction and the graph operators must find there follows from the columns without parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(p: Column) -> Column:
    """The name of a part's function."""
    group = 1 + F.floor(p / 10) % 5
    return F.concat(F.lit("fn_"), p - p % group, F.lit("_"), group)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, content and language of all files."""
    supplier = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    n = F.broadcast(supplier.agg(F.count("*").alias("n")))  # one row
    part = _table(spark, sf_dir, "part").crossJoin(n).select(
        F.col("p_partkey").alias("p"), (F.col("p_partkey") % F.col("n")).alias("s"), (F.col("p_size") % 5).alias("kind"), (F.col("p_size") % 2 == 0).alias("even"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    calls = _table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p"), F.lead("l_partkey").over(order).alias("callee"), (F.col("l_returnflag") == "R").alias("loop"))
    known = part.select(F.col("p").alias("callee")).hint("merge")
    calls = calls.where("p is not null and callee is not null").join(known, "callee", "left_semi")
    # a call travels as one number, twice its callee, and one more in a loop; of a callee's two numbers the larger counts
    packed = F.array_sort(F.collect_set(F.shiftleft("callee", 1) + F.coalesce(F.col("loop"), F.lit(False)).cast("long")))
    calls = calls.groupBy("p").agg(packed.alias("calls"))
    # a file's text is put together after its functions have met: until then a function is a few numbers
    fn = F.struct("p", "kind", "even", F.coalesce("calls", F.array().cast("array<bigint>")).alias("calls"))
    # dealt by number, as what is read out of the files is much more work than the bytes of these rows suggest
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bodies = part.join(calls.hint("merge"), "p", "left").repartition(parts, "s").groupBy("s").agg(F.array_sort(F.collect_list(fn)).alias("functions"))

    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    head = "    for (int i = 0; i < x; i++) {"
    cpp_loop = lit(head, "        a.push_back(i);", "    }")

    def python_risk(f: Column) -> Column:
        return F.when(f["kind"] == 0, lit("    eval(x)")).when(f["kind"] == 1, lit("    pickle.loads(x)")).when(f["kind"] == 2, lit("    for i in a:", "        open(x)")).otherwise(lit("    pass"))

    def cpp_risk(f: Column) -> Column:
        return F.when(f["kind"] == 0, lit("    strcpy(a, b);")).when(f["kind"] == 1, lit("    atoi(a);")).when(
            (f["kind"] == 2) & f["even"], F.concat(lit("    a.reserve(x);"), cpp_loop)).when(f["kind"] == 2, cpp_loop).otherwise(lit("    x = 1;"))

    def lines_of_calls(f: Column, in_loop, plain) -> Column:
        calls = f["calls"]
        kept = F.filter(calls, lambda x, k: (x.bitwiseAND(1) == 1) | (F.coalesce(F.get(calls, k + 1), x) != x + 1))
        return F.flatten(F.transform(kept, lambda x: F.when(x.bitwiseAND(1) == 1, in_loop(_name(F.shiftright(x, 1)))).otherwise(plain(_name(F.shiftright(x, 1))))))

    def python(f: Column) -> Column:
        calls = lines_of_calls(f, lambda name: F.array(F.lit("    for i in a:"), F.concat(F.lit("        "), name, F.lit("(i)"))), lambda name: F.array(F.concat(F.lit("    "), name, F.lit("(x)"))))
        return F.concat(F.array(F.concat(F.lit("def "), _name(f["p"]), F.lit("(a, x):"))), python_risk(f), calls, lit(""))

    def cpp(f: Column) -> Column:
        calls = lines_of_calls(f, lambda name: F.array(F.lit(head), F.concat(F.lit("        "), name, F.lit("(a, i);")), F.lit("    }")), lambda name: F.array(F.concat(F.lit("    "), name, F.lit("(a, x);"))))
        return F.concat(F.array(F.concat(F.lit("int "), _name(f["p"]), F.lit("(int* a, int x) {"))), cpp_risk(f), calls, lit("}", ""))

    lines = F.flatten(F.when(F.col("s") % 2 == 0, F.transform("functions", python)).otherwise(F.transform("functions", cpp)))
    bodies = bodies.select("s", lines.alias("lines"))

    target = (7 * F.col("s") + 2) % F.col("n")
    ending = lambda k: F.when(k % 2 == 0, ".py").when(k % 6 == 1, ".h").otherwise(".cpp")
    file = lambda k: F.concat(F.lit("d"), k % 10, F.lit("/m"), k, ending(k))
    same = target % 2 == F.col("s") % 2
    k = F.col("s").cast("string")
    some = lambda when, *x: F.when(when, F.array(*x)).otherwise(F.array().cast("array<string>"))
    near = F.col("s") + 10  # the next file of the same folder and language, if there is one
    from_near = F.concat(F.when(F.col("s") % 4 == 0, F.concat(F.lit("from ..d"), near % 10, F.lit(".m"))).otherwise("from .m"), near, F.lit(" import K_"), near)
    python_head = F.concat(
        lit("import os"), some(same, F.concat(F.lit("import m"), target)), some(F.col("s") % 3 == 0, F.lit("import numpy.linalg")), some(F.col("s") % 5 == 0, F.lit("import yaml")),
        F.array(from_near), F.array(F.concat(F.lit("K_"), k, F.lit(" = 1"))))
    cpp_head = F.concat(
        lit("#include <vector>"), some(same, F.concat(F.lit('#include "'), file(target), F.lit('"'))), F.array(F.concat(F.lit('#include "../'), file(near), F.lit('"'))),
        F.array(F.concat(F.lit("#define K_"), k, F.lit(" 1"))))
    files = supplier.crossJoin(n).join(bodies.hint("merge"), "s", "left")
    text = F.array_join(F.concat(F.when(F.col("s") % 2 == 0, python_head).otherwise(cpp_head), F.coalesce("lines", F.array().cast("array<string>"))), "\n")
    return files.select(F.lit("repo").alias("repo"), F.concat(F.lit("repo/"), file(F.col("s"))).alias("path"), text.alias("content"), F.when(F.col("s") % 2 == 0, "Python").otherwise("C++").alias("language"))


#: The same corpus for DuckDB, as facts: files, functions with their lines, calls with their lines, imports.
FACTS = """
    n AS (SELECT count(*) AS n FROM supplier),
    file AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 2 = 0 THEN 'Python' ELSE 'C++' END AS language,
        'repo/d' || (s_suppkey % 10) || '/m' || s_suppkey || (CASE WHEN s_suppkey % 2 = 0 THEN '.py' WHEN s_suppkey % 6 = 1 THEN '.h' ELSE '.cpp' END) AS path,
        (7 * s_suppkey + 2) % n AS target, ((7 * s_suppkey + 2) % n) % 2 = s_suppkey % 2 AS imports, s_suppkey + 10 AS near,
        3 + (((7 * s_suppkey + 2) % n) % 2 = s_suppkey % 2)::INT + (s_suppkey % 6 = 0)::INT + (s_suppkey % 10 = 0)::INT AS head FROM supplier, n),
    li AS (SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS callee,
        l_returnflag = 'R' AS loop FROM lineitem),
    call0 AS (SELECT caller, callee, bool_or(loop) AS loop FROM li WHERE callee IS NOT NULL GROUP BY ALL),
    fn0 AS (SELECT p_partkey AS p, p_partkey % n AS s, p_size % 5 AS kind, p_size % 2 = 0 AS even, 1 + (p_partkey // 10) % 5 AS g FROM part, n),
    fn1 AS (SELECT p, fn0.s, kind, even, language, path, 'fn_' || (p - p % g) || '_' || g AS name,
        CASE WHEN language = 'Python' THEN (CASE WHEN kind = 2 THEN 2 ELSE 1 END) ELSE (CASE WHEN kind = 2 THEN 3 + even::INT ELSE 1 END) END AS risk FROM fn0 JOIN file USING (s)),
    call1 AS (SELECT caller, callee, c.loop, CASE WHEN c.loop THEN (CASE WHEN language = 'Python' THEN 2 ELSE 3 END) ELSE 1 END AS size FROM call0 c JOIN fn1 ON fn1.p = caller),
    sized AS (SELECT fn1.*, 1 + risk + coalesce((SELECT sum(size) FROM call1 WHERE caller = p), 0) + (language = 'C++')::INT AS n_lines FROM fn1),
    fn AS (SELECT *, 1 + head + coalesce(sum(n_lines + 1) OVER (PARTITION BY s ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
        FROM sized JOIN (SELECT s, head FROM file) USING (s)),
    call AS (SELECT caller, callee, c.loop, f.s, f.language, f.path, f.name AS caller_name, g.name AS name, f.first + 1 + f.risk + c.loop::INT
        + coalesce(sum(size) OVER (PARTITION BY caller ORDER BY callee ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
        FROM call1 c JOIN fn f ON f.p = caller JOIN fn1 g ON g.p = callee),
    share AS (SELECT name, count(*) AS n_same FROM fn1 GROUP BY name)"""
