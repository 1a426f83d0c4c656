"""Hand-written sources and answers with their expected rows."""

import time

import pytest
from pyspark.sql import functions as F

from sourceloom.functions import text as T
from sourceloom.operators import graph, prompts, signals
from sourceloom.operators.ranking import numbered
from sourceloom.sources import extract as X
from sourceloom.sources.cpp import read_cpp
from sourceloom.sources.files import quarantine

PYTHON = '''import os, a.b as c
from . import x, y
from .m import z
from pkg.sub import w
LIMIT: int = 3
A = B = 1
t[0] = 2
D += 1

@deco
async def outer(a,
                b):  # say hello
    """Doc."""
    def inner():
        helper(os.path.join(a))
    return inner() + self.go.run(b)

class K(Base):
    LOCAL = 5
    def m(self):
        return m2()
'''
CPP = '''#include <vector>
#include "dir/util.h"
#define TOP 1
#ifndef GUARD
#define HIDDEN 2
#endif
namespace ns {
struct Node { int x; };
enum class Kind { A, B };
/* void no() { } */
class Tree : public Base {
public:
  ~Tree() { drop(); }
  int size() const { return count<int>(a->b.len(x)); }
};
X::~X() { free_all(); }
int a::b::f(const char* s) { // go
  const char* t = "} {";
  for (int i = 0; i < 3; i++) { ns::call(i); }
  return g(s);
}
bool operator==(const A& a, const A& b) { return same(a, b); }
}
'''


def extracted(spark, content, language, path="p"):
    return X.extract(spark.createDataFrame([("r", path, content, language)], "repo string, path string, content string, language string"))


def test_python_definitions(spark):
    found = extracted(spark, PYTHON, "Python")
    rows = [(r.name, r.symbol_type, r.start_line, r.end_line, r.parent, r.called_names) for r in X.chunks_of(found).orderBy("pos").collect()]
    assert rows == [
        ("outer", "function", 11, 16, None, ["inner", "run"]), ("inner", "method", 14, 15, 0, ["helper", "join"]),
        ("K", "class", 18, 21, None, []), ("m", "method", 20, 21, 2, ["m2"])]
    assert [r.target for r in X.includes_of(found).collect()] == ["os", "a.b", "x", "y", ".m", "pkg.sub"]
    assert [(r.name, r.line) for r in X.constants_of(found).collect()] == [("LIMIT", 5), ("A", 6)]
    first = X.chunks_of(found).where("pos = 0").first()
    assert first.source.startswith("async def outer(a,\n") and first.is_container and first.signature == "async def outer(a, b)"


def test_python_that_does_not_parse(spark):
    found = extracted(spark, "def ok(a):\n    go(a)\n\ndef bad(:\n    x = = 1\nY = 2\n", "Python")
    assert [(r.name, r.start_line, r.end_line) for r in X.chunks_of(found).orderBy("pos").collect()] == [("ok", 1, 2), ("bad", 4, 5)]
    assert found.first().error is None


def test_cpp_definitions(spark):
    found = extracted(spark, CPP, "C++")
    rows = {r.name: (r.symbol_type, r.start_line, r.end_line, sorted(r.called_names)) for r in X.chunks_of(found).collect()}
    assert rows["ns"][:3] == ("namespace", 7, 23)
    assert rows["Node"] == ("struct", 8, 8, []) and rows["Kind"] == ("enum", 9, 9, [])
    assert rows["Tree"][:3] == ("class", 11, 15) and rows["size"] == ("method", 14, 14, ["count", "len"])
    assert rows["~X"] == ("method", 16, 16, ["free_all"]) and rows["b::f"] == ("method", 17, 21, ["call", "g"])
    assert "no" not in rows and "~Tree" not in rows and not any("operator" in n for n in rows)
    assert [(r.target, r.is_system) for r in X.includes_of(found).collect()] == [("vector", True), ("dir/util.h", False)]
    assert [r.name for r in X.constants_of(found).collect()] == ["TOP"]


def test_odd_files(spark):
    for content, language in (("", "Python"), ("", "C++"), ("int f() {", "C++"), ("}}}", "C++"), ("def f(): pass", "Python"), ("#define A\\\n b\n", "C++")):
        assert extracted(spark, content, language).first().error is None
    rows = X.extract(spark.createDataFrame([("r", "p", None, "Python")], "repo string, path string, content string, language string")).collect()
    assert rows[0].error == "not valid UTF-8" and rows[0].chunks == []


@pytest.mark.parametrize(("lines", "depths"), [
    (["for x in y:", "  a", "", "  while b:", "    c", "d"], [0, 1, 1, 1, 2, 0]), (["for x in y: f()", "a"], [0, 0]),
    (["async for x in y:", "    # gone", "    a"], [0, 1, 1]), ([""], [0])])
def test_python_loops(lines, depths):
    assert signals.depths_of(lines, "Python") == depths


@pytest.mark.parametrize(("lines", "depths"), [
    (["for (;;) {", "a;", "}", "b;"], [0, 1, 1, 0]), (["do {", "a;", "} while (x);", "b;"], [0, 1, 1, 0]), (["for (;;)", "  a;", "b;"], [0, 0, 0]),
    (['while (x) { s = "}";', "a;", "}"], [0, 1, 1]), (["if (a) {", "while (b)", "{", "c;", "}", "}"], [0, 0, 0, 1, 1, 0])])
def test_cpp_loops(lines, depths):
    assert signals.depths_of(lines, "C++") == depths


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_security_match_over_two_lines(spark):
    code = F.lit("def f():\n  eval\n  (x)\n  eval(y); eval(z)")
    assert value(spark, signals.security_offsets(code, r"\b(eval|exec)\s*\(")) == [1, 3]


def test_cpp_comments(spark):
    assert value(spark, T.strip_cpp_comments(F.lit("a /* x\n/* y */ b // c\nd /* open"))) == "a \n b \nd /* open"


@pytest.mark.parametrize(("lines", "windows"), [([], []), ([50], [(38, 62)]), ([1, 100], [(1, 13), (88, 100)]), ([50, 75], [(38, 87)]), ([50, 76], [(38, 62), (64, 88)]), ([13, 38, 48], [(1, 60)]), ([13, 38, 49], [(1, 50), (37, 61)])])
def test_focus_windows(spark, lines, windows):
    found = value(spark, signals.focus_windows(F.lit(lines).cast("array<int>") if lines else F.array().cast("array<int>"), F.lit(1), F.lit(100)))
    assert [(w.first, w.last) for w in found] == windows


@pytest.mark.parametrize(("text", "tidy"), [
    ("unsafe casts", "unsafe casts"), ("One. Two. One.", "One. Two."), ("a" * 99, "a" * 99), ("First part. " + "b " * 50, "First part."),
    ("word " * 20 + "cut", ("word " * 20).strip() + "..."), ("Uses `j.m` and. " * 7 + "then `open", "Uses `j.m` and.")])
def test_tidy_answers(spark, text, tidy):
    assert value(spark, T.tidy_answer(F.lit(text))) == tidy


@pytest.mark.parametrize(("text", "done"), [("Builds the table, then checks...", "Builds the table, then checks..."), ("Builds the whole table first, then checks...", "Builds the whole table first."), ("No cut", "No cut")])
def test_finish_cut_off(spark, text, done):
    assert value(spark, T.finish_cut_off(F.lit(text))) == done


def test_lists_and_durations(spark):
    names = F.array(*[F.lit(str(k)) for k in range(10)])
    assert value(spark, T.list_names(names)) == "0, 1, 2, 3, 4, 5, 6, 7 and 2 more"
    assert [value(spark, T.join_clauses(F.slice(names, 1, k))) for k in (0, 1, 2, 3)] == ["", "0", "0 and 1", "0, 1 and 2"]
    assert [value(spark, T.duration(F.lit(float(s)))) for s in (90, 119.4, 120, 300)] == ["90 second", "119 second", "2 minute", "5 minute"]


def test_include_rules(spark):
    files = spark.createDataFrame([("r", p) for p in ("a/util.h", "b/util.h", "x/y/mod.py", "z/mod.py", "main.py")], "repo string, path string")
    asked = [("a/util.h", "util.h"), ("b/c.cpp", "a/util.h"), ("b/c.cpp", "../a/util.h"), ("main.py", "y.mod"), ("main.py", "mod"), ("main.py", "os.path"), ("z/mod.py", "main")]
    includes = spark.createDataFrame([("r", p, t) for p, t in asked], "repo string, path string, target string")
    got = sorted((r.path, r.target, r.kind, r.dependency) for r in graph.resolve_includes(includes, files).collect())
    assert got == [
        ("a/util.h", "util.h", "internal", "b/util.h"), ("b/c.cpp", "../a/util.h", "internal", "a/util.h"), ("b/c.cpp", "a/util.h", "internal", "a/util.h"),
        ("main.py", "mod", "internal", "x/y/mod.py"), ("main.py", "mod", "internal", "z/mod.py"), ("main.py", "os.path", "external", "os"),
        ("main.py", "y.mod", "internal", "x/y/mod.py"), ("z/mod.py", "main", "internal", "main.py")]


def test_relative_and_local_targets(spark):
    """Relative targets start at the including file; what only the listing has beside it is local, not outside."""
    files = [("r/a/x.py",), ("r/zz/m.py",), ("r/p/q.py",), ("r/a/sub/__init__.py",), ("r/u.h",), ("r/a/c.cpp",), ("r/b/y.py",)]
    listing = files + [("r/a/near.py",), ("r/a/near.h",), ("r/b/m.py",)]
    wanted = [
        ("r/a/x.py", ".m", False), ("r/b/y.py", ".m", False), ("r/a/x.py", "..p.q", False), ("r/a/x.py", ".sub", False), ("r/a/x.py", "....deep", False), ("r/a/x.py", "near", False),
        ("r/a/x.py", "zz.m", False), ("r/a/c.cpp", "../u.h", False), ("r/a/c.cpp", "near.h", False), ("r/a/c.cpp", "near.h", True), ("r/a/c.cpp", "../none.h", False)]
    frame = lambda rows: spark.createDataFrame([("repo", *r) for r in rows], "repo string, path string" + (", target string, is_system boolean" if len(rows[0]) > 1 else ""))
    got = graph.resolve_includes(frame(wanted[:9] + wanted[10:]), frame(files), frame(listing)).collect()
    assert sorted((r.target, r.path[2:], r.kind, r.dependency) for r in got) == [
        ("....deep", "a/x.py", "local", "....deep"), ("../none.h", "a/c.cpp", "external", "../none.h"), ("../u.h", "a/c.cpp", "internal", "r/u.h"), ("..p.q", "a/x.py", "internal", "r/p/q.py"),
        (".m", "a/x.py", "local", ".m"), (".m", "b/y.py", "local", ".m"), (".sub", "a/x.py", "internal", "r/a/sub/__init__.py"),
        ("near", "a/x.py", "local", "near"), ("near.h", "a/c.cpp", "local", "near.h"), ("zz.m", "a/x.py", "internal", "r/zz/m.py")]
    assert [r.kind for r in graph.resolve_includes(frame(wanted[9:10]), frame(files), frame(listing)).collect()] == ["external"]
    assert graph.resolve_includes(frame(wanted).limit(0), frame(files)).collect() == []


def test_numbers_of_large_groups(spark):
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, null, id % 2) as g", "(id * 7919) % 1000 as v")
    got = numbered(rows, ["g"], [F.desc("v")], "place", 7).collect()
    for g in (None, 0, 1):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and [r.v for r in own] == sorted((r.v for r in own), reverse=True)
    assert numbered(rows.limit(0), ["g"], ["v"], "place").collect() == []


def test_blocks_are_whole_or_left_out(spark):
    blocks = F.array(F.lit("a" * 30), F.lit("b" * 80), F.lit("c" * 20), F.lit("d"))
    packed = value(spark, prompts.pack_whole(F.lit("s"), blocks, 60, 2, "HEAD"))
    assert (packed.text, packed.n) == ("sHEAD" + "a" * 30 + "c" * 20, 2)


def test_chunks_do_not_depend_on_partitions(spark, sf_dir):
    from sourceloom.plans.code_view import code_files

    files = code_files(spark, sf_dir)
    rows = [sorted(map(str, graph.call_edges(X.chunks_of(X.extract(files.repartition(n)))).select("caller", "callee", "path", "callee_path").collect())) for n in (1, 8)]
    assert rows[0] == rows[1]
    assert all(r.path != r.callee_path or r.pos != r.callee_pos for r in graph.call_edges(X.chunks_of(X.extract(files))).collect())


CPP_MORE = '''template <class T, int N = 3> class EXPORT Foo final : public Bar<int> {
public:
  int x{0};
  explicit Foo(int a) noexcept : x{a}, y(2) { made(); }
  static int s(int q = k(2)) { return q; }
  int v = init(3);
  void decl(int);
private:
  T _p() const { auto l = [&](int z) { return m(z); }; return l(1); }
};
A::A(int x) : a(x), b{1}
{ g(1); }
template <typename T> void Foo<T>::bar(std::map<int, std::vector<T>> m) {
  Foo x(1); auto p = new Foo(2);
  for (auto& e : m) { use(e); }
  g<std::vector<std::vector<int>>>(1);
  if (a < b && c > (d)) h(x >> y, int(2));
}
const char* r = R"x(int no() { bad(); } )" )x";
extern "C" { int c_fun(void) { return 1'000; } }
namespace a::b { int z() { struct L { int q() { return t(); } }; return 0; } }
struct P f2(int a) { return P{a}; }
int last() {
  open('''


def test_cpp_brackets_and_templates(spark):
    found = extracted(spark, CPP_MORE, "C++")
    rows = [(r.name, r.symbol_type, r.parent, r.start_line, r.end_line, r.called_names) for r in X.chunks_of(found).orderBy("pos").collect()]
    assert rows == [
        ("Foo", "class", None, 1, 10, ["init"]), ("Foo", "method", 0, 4, 4, ["made"]), ("s", "method", 0, 5, 5, []), ("_p", "method", 0, 9, 9, ["m", "l"]),
        ("A", "function", None, 11, 12, ["g"]), ("bar", "function", None, 13, 18, ["use", "g", "h"]), ("c_fun", "function", None, 20, 20, []),
        ("a::b", "namespace", None, 21, 21, []), ("z", "method", 7, 21, 21, []), ("L", "struct", 8, 21, 21, []), ("q", "method", 9, 21, 21, ["t"]),
        ("f2", "function", None, 22, 22, []), ("last", "function", None, 23, 24, ["open"])]
    assert X.chunks_of(found).where("name = 'A'").first().signature == "A::A(int x) : a(x), b{1}"


@pytest.mark.parametrize("unit", ["(", "<", "a<", "{", 'R"(', "for (;;", '"', "/*", "a<b>(", "template <", "x::", "class A : ", "b{1}, ", "}", "[[", "#if\n"])
def test_cpp_is_read_in_linear_time(unit):
    began = time.time()
    read_cpp("A::A() : " + unit * 30_000)
    assert time.time() - began < 5


def test_files_that_fail_are_put_aside(spark, monkeypatch):
    rows = [("r", "mac.py", "x = 1\rdef f():\r  return g(1)\r", "Python"), ("r", "deep.py", "x = " + "(" * 5000 + "1" + ")" * 5000 + "\ndef f():\n  g()\n", "Python"),
            ("r", "zero.py", "def f():\n  g()\n\0", "Python"), ("r", "bad.py", None, "Python"), ("r", "ok.cpp", "int f() { g(); }", "C++")]
    found = X.extract(spark.createDataFrame(rows, "repo string, path string, content string, language string"))
    good, bad = quarantine(found)
    assert sorted((r.path, r.name, r.start_line, r.called_names) for r in X.chunks_of(good).collect()) == [
        ("deep.py", "f", 2, ["g"]), ("mac.py", "f", 2, ["g"]), ("ok.cpp", "f", 1, ["g"]), ("zero.py", "f", 1, ["g"])]
    assert [(r.path, r.reason) for r in bad.collect()] == [("bad.py", "not valid UTF-8")]


def test_any_error_of_a_file_is_its_own(monkeypatch):
    monkeypatch.setattr(X, "read_cpp", lambda text: 1 / 0)
    assert X._read("int f() {}", "C++") == ("ZeroDivisionError", ([], [], []))
    assert X._read("def f(): pass", "Python")[0] is None
