"""Search within groups and related code, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceloom.operators import signals
from sourceloom.operators.related import nearest_within, related_code
from sourceloom.operators.vectors import best_of_block
from sourceloom.plans.review import plan_prompts, review_plan
from sourceloom.sources import extract

VECTORS = "repo string, id long, vector array<double>"
CHUNKS = "repo string, path string, pos int, name string, symbol_type string, start_line int, end_line int, source string, vector array<double>"


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_within_groups(spark, block):
    random = np.random.default_rng(5)
    rows = [(f"r{g}", k, [float(x) for x in random.integers(0, 3, 4)]) for g, n in enumerate((60, 9, 1)) for k in range(n)]
    rows.append((None, 1, [1.0, 1.0, 1.0, 1.0]))
    asked = [r for r in rows if r[1] % 3 == 0] + [("elsewhere", 5, [1.0, 0.0, 0.0, 0.0])]
    found = nearest_within(spark.createDataFrame(asked, VECTORS), spark.createDataFrame(rows, VECTORS), "repo", 5, block)
    expected = set()
    for repo, query, vector in asked:
        best = sorted((-float(np.dot(vector, v)), k) for r, k, v in rows if r == repo and repo is not None)[:5]
        expected |= {(repo, query, k, -score, place) for place, (score, k) in enumerate(best, 1)}
    assert {tuple(r) for r in found.select("repo", "query_id", "id", "score", "place").collect()} == expected
    empty = spark.createDataFrame([], VECTORS)
    assert nearest_within(empty, empty, "repo", 5).count() == 0


def test_best_of_block_keeps_ties_in_order_of_ids():
    import pandas as pd

    queries = pd.DataFrame({"query_id": [1, 2], "query": [[1.0, 0.0], [float("nan"), 0.0]]})
    vectors = pd.DataFrame({"key": [9, 3, 5, 1], "value": [[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 1.0]]})
    assert best_of_block(2)(queries, vectors)["id"].tolist() == [5, 3, 1, 3]
    assert best_of_block(9)(queries, vectors)["id"].tolist()[:4] == [5, 3, 9, 1]


def test_related_code_stays_in_its_repository_and_outside_itself(spark):
    near, far = [1.0, 0.0], [0.0, 1.0]
    rows = [
        ("a", "x/m.py", 0, "whole", "class", 1, 20, "class whole: ...", near),  # holds the target
        ("a", "x/m.py", 1, "target", "method", 5, 9, "def target(): ...", near),
        ("a", "x/m.py", 2, "beside", "method", 30, 31, "def beside():\r\n  ...", near),
        ("a", "y/n.py", 0, "other", "function", 3, 4, "def other(): ...", near),
        ("a", "y/n.py", 1, "long", "function", 5, 400, "x" * 500, near),
        ("a", "y/n.py", 2, "unlike", "function", 500, 501, "def unlike(): ...", far),
        ("b", "x/m.py", 0, "same", "function", 1, 2, "def same(): ...", near),
        (None, "x/m.py", 0, "none", "function", 1, 2, "def none(): ...", near),
    ]
    chunks = spark.createDataFrame(rows, CHUNKS)
    targets = chunks.where("pos = 1 or repo = 'b' or repo is null")
    found = {(r.repo, r.path, r.pos): r.related for r in related_code(targets, chunks, longest=200).collect()}
    assert found == {
        ("a", "x/m.py", 1): ["[method 'beside', lines 30-31]\ndef beside():\n  ...", "[function 'other', lines 3-4 of n.py]\ndef other(): ..."],
        ("a", "y/n.py", 1): [
            "[class 'whole', lines 1-20 of m.py]\nclass whole: ...", "[method 'target', lines 5-9 of m.py]\ndef target(): ...", "[method 'beside', lines 30-31 of m.py]\ndef beside():\n  ...",
            "[function 'other', lines 3-4]\ndef other(): ..."],
    }
    assert related_code(targets.limit(0), chunks.limit(0)).count() == 0


def test_prompts_of_a_plan(spark):
    text = "class Box:\n    def run(self, x):\n        eval(x)\n\ndef alone(x):\n    eval(x)"
    files = spark.createDataFrame([("a", "x/m.py", text, "Python")], "repo string, path string, content string, language string")
    chunks = extract.chunks_of(extract.extract(files))
    scanned = signals.scan_chunks(chunks)
    plan, skipped = review_plan(scanned, scanned.limit(0))
    related = chunks.select("repo", "path", "pos", F.array(F.lit("[one]\n1"), F.repeat(F.lit("x"), F.lit(3000)), F.lit("[two]\n2")).alias("related")).where("name = 'run'")
    made = {r.prompt.split("'")[1]: r for r in plan_prompts(plan, chunks, related).collect()}
    assert set(made) == {"run", "alone"} and skipped.count() == 0
    assert made["run"].prompt.split("\n")[1:5] == ["CODE UNDER REVIEW (method 'run', lines 2-3 of m.py)", "It is defined inside class 'Box'.", "2 | def run(self, x):", "3 |         eval(x)"]
    assert made["run"].n_related == 2 and made["run"].prompt.endswith("\nRELATED CODE (background only, do not review):\n[one]\n1\n\n[two]\n2\n")
    assert made["alone"].n_related == 0 and "RELATED" not in made["alone"].prompt and "defined inside" not in made["alone"].prompt
    assert {r.n_related for r in plan_prompts(plan, chunks).collect()} == {0}
