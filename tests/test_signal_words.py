"""The words of signals: every match of a pattern holds one, and scanning by words finds what scanning without them does."""

import dataclasses

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.operators import signals
from sourceloom.plans.code_view import code_files
from sourceloom.sources import extract

TABLES = (rules.PYTHON_SECURITY, rules.PYTHON_PERFORMANCE, rules.CPP_SECURITY, rules.CPP_PERFORMANCE)
ALL = [s for table in TABLES for s in table]


@pytest.mark.parametrize("signal", ALL, ids=lambda s: s.description)
def test_every_match_holds_a_word(signal):
    @settings(max_examples=100, deadline=None, database=None)
    @given(st.from_regex(signal.pattern))
    def check(text):
        assert any(word in text for word in signal.words)

    check()


def test_words_change_no_hint(spark, sf_dir):
    chunks = extract.chunks_of(extract.extract(code_files(spark, sf_dir)))
    odd = ["memset (a)", "while(1) {", "for (;;) {\n  v.push_back(1); std::string s = f(\"new\");\n}", "x = f(1)", "", "new\nint [3]", "def f():\n  while True:\n    s = s + 'a'\n    sorted(a)"]
    rows = [("r", f"f{k}", lang, k, text, 1) for k, text in enumerate(odd) for lang in ("Python", "C++")]
    made = spark.createDataFrame(rows, "repo string, path string, language string, pos int, source string, start_line int")
    plain = tuple(tuple(dataclasses.replace(s, words=()) for s in table) for table in TABLES)
    found = 0
    for some in (chunks, made):
        scan = lambda *tables: sorted(map(str, signals.scan_chunks(some, *tables).select("repo", "path", "language", "pos", "depths", "hints").collect()))
        assert scan() == scan(plain[:2], plain[2:])
        found += signals.scan_chunks(some).where(F.size("hints") > 0).count()
    assert found > 50


def test_a_table_with_and_without_words():
    own = signals.Words((rules.Signal(2, "a", "a", words=("aa", "b")), rules.Signal(2, "b", "b"), rules.Signal(2, "c", "c", words=("caab",))))
    assert own.possible("") == [1] and own.possible("xaab") == [0, 1] and own.possible("caab") == [0, 1, 2]
    assert signals.Words(()).possible("x") == []
