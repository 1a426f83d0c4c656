import hashlib
import html
import math
import re
import struct
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from sourceloom.llm import html_text, media, ordinal_quality, quality_rules, sharding, toxicity


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    return con.sql(sql).fetchall()


# Quality rules


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_match_sql_and_brute_force(spark, sf_dir, sample, edge_docs, empty_docs):
    rows = quality_rules.quality_measures(sample).collect()
    assert sorted(map(tuple, rows)) == sorted(duck(sf_dir, quality_rules.oracle_sql()))
    repeats = [(100 + k, t) for k, t in enumerate(["a b c d e f g h i a b c d e f g h", "x " * 30, "x y " * 9, "a|b\na|b\n\n \n", "p q r s t u v w x " * 3])]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(repeats, "doc_id long, text string"))
    text = {(r.doc_id, r.text) for r in docs.collect()}
    got = quality_rules.quality_measures(docs).collect()
    measured = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got}
    assert measured == {(k, *brute_measures(t)) for k, t in text} and len(got) == docs.count()
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept <= (not r.base_failed) for r in got)
    assert quality_rules.quality_measures(empty_docs).collect() == []


def test_quality_filter_keeps_columns(edge_docs, sample):
    assert quality_rules.drop_low_quality(edge_docs).columns == edge_docs.columns
    kept = {r.doc_id for r in quality_rules.quality_measures(sample).where("kept").collect()}
    assert {r.doc_id for r in quality_rules.drop_low_quality(sample).collect()} == kept


def test_quality_runs_without_python(sample):
    plan = quality_rules.quality_measures(sample)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Toxicity


@pytest.mark.parametrize(("text", "folded"), [
    ("1d10t!", " idiot "), ("M0R0N", " moron "), ("lоsеr", " ioser "), ("the$$$ $tupid", " the stupid "), ("st​upid", " stupid "),
    ("a\n\n b", " a b "), ("", " "), ("...", "  "),
])
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def test_exceptions_spare_matches():
    model = toxicity.ToxicityModel({" trash ": 2.0, " idio": 3.0}, (" trash can ",), -1.0, 3.0)
    matcher = toxicity.Matcher(model)
    assert matcher.sums("The trash can is full") == (0, 5)
    assert matcher.sums("trash, id1ots; trash can") == (5.0, 4)
    assert toxicity.Matcher(toxicity.ToxicityModel()).sums("trash") == (0, 1)


def test_toxicity_learns_planted_words(spark, edge_docs, empty_docs):
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        words = [f"word{(k * 7 + i * 13) % 97}" for i in range(30)] + (["grumbo", "vexlarion"[: 6 + k % 3]] if bad else ["trash" if k % 8 == 1 else "calm"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(p.startswith(" grum") for p in model.weights)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, model).collect()}
    assert all(got[k].predicted == y and 0 <= got[k].score <= 1 for k, y in labels)
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _ in labels)
    unseen = spark.createDataFrame([(1, "a b c GRUMB0 d"), (2, "a b c d")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.toxicity_scores(unseen, model).orderBy("doc_id").collect()] == [1, 0]
    assert toxicity.toxicity_scores(edge_docs, model).count() == edge_docs.count()
    assert toxicity.toxicity_scores(empty_docs, model).collect() == []
    kept = toxicity.drop_toxic(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    assert {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()} == {k for k, y in labels if not y}
    nothing = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert nothing.weights == {} and toxicity.drop_toxic(docs, nothing).count() == 400


def test_labels_without_a_pattern_drop_nothing(spark):
    docs = spark.createDataFrame([(k, f"only{k} words{k} here{k}") for k in range(60)], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int"))
    assert model.weights == {} and toxicity.drop_toxic(docs, model).count() == 60


def test_toxicity_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scores = toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in scores) >= 0.93 * len(scores)


def test_toxicity_against_brute_force(spark):
    """Lexicon, exceptions, curve and scores computed once more by plain loops over all labelled rows."""
    folder, prefixes = "/root/testdata/sf0.01", (4, 5, 6, 7, 8)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: toxicity.fold(r.text or "") for r in docs.collect()}
    patterns = {}
    for d in known:
        words = set(texts[d].split())
        patterns[d] = {f" {w} " for w in words} | {" " + w[:n] for w in words for n in prefixes if len(w) > n}
    toxic, clean = [d for d in known if known[d]], [d for d in known if not known[d]]
    kin = {}
    for d in toxic:
        words = texts[d].split()
        kin[d] = min(xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2)))
    weights = {}
    support = {p: len({kin[d] for d in toxic if p in patterns[d]}) for p in set().union(*(patterns[d] for d in toxic))}
    for p, n in sorted(support.items(), key=lambda x: len(x[0].rstrip())):
        m = sum(p in patterns[d] for d in clean)
        weight = math.log(((n + 0.5) / (len(toxic) + 1)) / ((m + 0.5) / (len(clean) + 1)))
        if n >= max(5, 0.01 * len(toxic)) and weight >= math.log(10) and not any(p != q and p.startswith(q) for q in weights):
            weights[p] = weight
    model = toxicity.fit_toxicity(docs, labels)
    assert model.weights == pytest.approx(weights) and weights

    def total(folded, spared=()):
        found = {}
        for start in range(len(folded)):
            best = max((w for p, w in weights.items() if folded.startswith(p, start)), default=None)
            if best is not None and not any(a <= start < a + len(x) - 1 for x in spared for a in range(len(folded)) if folded.startswith(x, a)):
                found[start] = best
        return found

    phrases = {0: Counter(), 1: Counter()}
    for d, y in known.items():
        words = texts[d].split()
        begins = [k for k in range(len(texts[d])) if texts[d][k] == " "]
        own = set()
        for start in total(texts[d]):
            k = begins.index(start)
            own |= {f" {words[k - 1]} {words[k]} "} if k else set()
            own |= {f" {words[k]} {words[k + 1]} "} if k + 1 < len(words) else set()
        phrases[y].update(own)
    assert sorted(model.exceptions) == sorted(p for p, n in phrases[0].items() if n >= 3 and not phrases[1][p])

    x = {d: math.log1p(100 * sum(total(texts[d], model.exceptions).values()) / max(len(texts[d].split()), 1)) for d in texts}
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, model).collect()}
    for d in texts:
        assert got[d].score == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, model.bias + model.slope * x[d])))))

    def loss(bias, slope):  # what the curve minimises, both classes weighted alike
        parts = {0: [], 1: []}
        for d, y in known.items():
            z = bias + slope * x[d]
            parts[y].append(math.log1p(math.exp(-z if y else z)))
        return sum(sum(v) / len(v) / 2 for v in parts.values()) + 0.001 * slope**2

    best = loss(model.bias, model.slope)
    assert all(best <= loss(model.bias + a, model.slope + b) + 1e-9 for a, b in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)))


def test_toxicity_takes_one_row_of_an_id(spark):
    rows = [(k, f"w{k} calm words here") for k in range(60)] + [(k, f"w{k} grumbo words here") for k in range(60, 100)] + [(7, "grumbo " * 5)] * 300
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k >= 60)) for k in range(100)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, "doc_id", "text", 3_000, 9_000).count() == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(100))
    long_word = "grumb" * 20
    docs = spark.createDataFrame([(k, f"w{k} {long_word if k >= 60 else long_word[:9]} here") for k in range(100)], "doc_id long, text string")
    assert f" {long_word} " in toxicity.fit_toxicity(docs, labels).weights


# Graded quality


def test_ordinal_against_brute_force(spark):
    """Scores from the features one by one, and the likelihood's gradient, by differences, near zero at the fit."""
    shapes = {"calm": "a", "ID1OT": "a9a", "###x": "##a", "river": "a", "Stone": "a", "a": "a", "9": "9", "idiotic": "a"}
    words = list(shapes)
    rows = [(k, " ".join(words[(k * 3 + i * i) % (3 + k % 6)] for i in range(5 + k % 7))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grades = spark.createDataFrame([(k, k % 6 // 2) for k in range(120)], "doc_id long, grade int")
    n, ridge = 1 << 12, 0.01
    model = ordinal_quality.fit_ordinal(docs, grades, n_features=n, rounds=2_000, ridge=ridge)

    def features(text):
        out, split, lines = Counter(), text.split(), text.split("\n")
        for w in split:
            low = {"ID1OT": "idiot", "###x": "x", "calm": "caim", "9": "9"}.get(w, w.lower())
            for x in ("w" + w.lower(), "s" + shapes[w], "f" + low, "4" + low[:4], "5" + low[:5], "6" + low[:6]):
                out[xxhash.xxh64_intdigest(x) % n] += 1 / len(split)
        for name, share in (("rprevious", sum(a == b for a, b in zip(split, split[1:])) / len(split)), ("rwords", 1 - len(set(split)) / len(split)), ("rlines", 1 - len(set(lines)) / len(lines))):
            out[xxhash.xxh64_intdigest(name) % n] += share
        return out

    table = {k: features(t) for k, t in rows}
    score = lambda f, weights: sum(weights[k] * x for k, x in f.items())
    got = {r.doc_id: r for r in ordinal_quality.grade_scores(docs, model).collect()}
    above = lambda s: [1 / (1 + math.exp(t - s)) for t in model.thresholds]
    for k, _ in rows:
        s = score(table[k], model.weights)
        assert got[k].score == pytest.approx(s, abs=1e-5)
        assert got[k].expected_grade == pytest.approx(sum(above(s)), abs=1e-5) and got[k].tail_probability == pytest.approx(above(s)[-1], abs=1e-5)
    used = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5]
    squares = Counter()
    for k in used:
        for f, x in table[k].items():
            squares[f] += x * x / len(used)

    def loss(weights, thresholds):
        cuts, total = [-math.inf, *thresholds, math.inf], 0
        for k in used:
            s, y = score(table[k], weights), k % 6 // 2
            total -= math.log(1 / (1 + math.exp(s - cuts[y + 1])) - 1 / (1 + math.exp(s - cuts[y]))) / len(used)
        return total + ridge / 2 * sum(weights[f] ** 2 * (squares[f] + 1e-3) for f in range(n))

    for f in sorted(squares, key=squares.get)[-5:]:
        step = np.zeros(n)
        step[f] = 1e-4 / math.sqrt(squares[f])
        slope = (loss(model.weights + step, model.thresholds) - loss(model.weights - step, model.thresholds)) / 2e-4
        assert abs(slope) < 3e-3
    for k in range(2):
        step = np.zeros(2)
        step[k] = 1e-4
        assert abs(loss(model.weights, model.thresholds + step) - loss(model.weights, model.thresholds - step)) / 2e-4 < 3e-3


def test_ordinal_grades(spark, edge_docs, empty_docs):
    rows = [(k, " ".join(f"{'bad###' if k % 3 == 0 else 'fair' if k % 3 == 1 else 'good'}{(k + i) % 5}" for i in range(20))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grades = spark.createDataFrame([(k, k % 3) for k in range(300)], "doc_id long, grade int")
    model = ordinal_quality.fit_ordinal(docs, grades, n_features=1 << 10)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = ordinal_quality.grade_scores(docs, model).collect()
    assert sum(round(r.expected_grade) == r.doc_id % 3 for r in got) >= 290
    assert all(0 <= r.tail_probability <= 1 for r in got)
    edge = ordinal_quality.grade_scores(edge_docs, model).collect()
    assert len(edge) == edge_docs.count()
    assert all(r.expected_grade == 0 and not r.selected for r in edge if r.doc_id in (0, 1, 2, 3))
    assert ordinal_quality.grade_scores(empty_docs, model).collect() == []
    flat = ordinal_quality.fit_ordinal(docs, grades.limit(0), n_features=16)
    assert len(flat.thresholds) == 0 and ordinal_quality.grade_scores(docs, flat).count() == 300


# Pages


def test_main_text_of_generated_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    for page in pages:
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", page.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", article.replace("<br>", " "))
        expected = "\n".join(b for b in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in blocks) if b)
        assert got[page.page_id].text == expected and got[page.page_id].n_chars == len(expected)


@pytest.mark.parametrize(("source", "text"), [
    ("", ""), ("   ", ""), ("<", "<"), ("<div><div>", ""), ("plain  text", "plain text"), ("a < b &amp; c&nbsp;d &unknown; &#233;", "a < b & c d &unknown; é"),
    ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one\ntwo\na\nb\nc"),
    ("<script>var x = '<p>no</p>'</script><p>yes<!-- <p>no --> still", "yes still"), ("<p class='ad>x</p><p>y</p>", "x\ny"),
    ("<body><header>Site</header><article><header><h1>T</h1></header><p>Body text</p><form>f</form></article><section class='reader-comments'><p>c</p></section></body>", "T\nBody text"),
    ("<div class=menu><a href=x>Home</a></div><div id=content><h2>Title</h2><p>Long text that is the article here.<p>Second paragraph too</div><div class='cookie-notice'>ok</div>", "Title\nLong text that is the article here.\nSecond paragraph too"),
])
def test_main_text_of_small_pages(source, text):
    assert html_text.main_text(source) == text


ARTICLE = "<h1>Title of it</h1><p>" + "word text here. " * 30 + "</p><p>" + "more of it now. " * 30 + "</p>"
READERS = "<div class=comments>" + "<p>Reader says something long enough to count as a paragraph of text.</p>" * 40 + "</div>"


@pytest.mark.parametrize("readers", ["", READERS])
@pytest.mark.parametrize("wrap", [
    "<article>%s</article>", "<div>%s</div>", "<div class='content no-sidebar'>%s</div>", "<div class='has-sidebar'><div>%s</div></div>", "<form><div>%s</div></form>",
    "<form action=x><article>%s</article></form>", "<div data-role=menu class='with-comments'>%s</div>", "<div id=discussion>%s</div>", "<section id=search><main>%s</main></section>",
])
def test_wrappers_do_not_hide_the_article(wrap, readers):
    menu = "<nav><ul>" + "".join(f"<li><a href=/x>link {k}</a></li>" for k in range(6)) + "</ul></nav>"
    page = f"<html><body>{menu}<div class='ad-slot'>Buy this now</div>{wrap % ARTICLE}{readers}<div class='site-footer'>All rights reserved by us</div></body></html>"
    assert html_text.main_text(page) == "\n".join(["Title of it", ("word text here. " * 30).strip(), ("more of it now. " * 30).strip()])


def test_names_inside_an_article():
    page = (
        "<body><article><h2 id='related-work'>Related work</h2><p class='share-price'>Shares fell today.</p><section id=discussion><p>We discuss.</p></section>"
        "<div class='share-buttons'>Tweet</div><aside>Beside</aside><p>End.</p></article></body>"
    )
    assert html_text.main_text(page) == "Related work\nShares fell today.\nWe discuss.\nEnd."


@pytest.mark.parametrize("source", ["<ul><li>x" * 100_000, "<a " * 300_000, "<div>" * 100_000 + "text", "<b>" * 100_000 + "x " * 1_000, "<p class='ad'>" * 50_000 + "y"])
def test_deep_pages_take_linear_time(source):
    began = time.process_time()
    html_text.main_text(source)
    assert time.process_time() - began < 12


def test_pages_edge_rows(spark):
    rows = [(1, None, None, 3), (None, "u", "<p>x", 3), (2, "u", "", 3), (2, "u", "", 3), (3, "v", "<p>" + "word " * 50_000, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract_text(pages).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [(0, "u", 1), (1, "", 0), (2, "u", 0), (2, "u", 0), (3, "v", 249_999)]
    assert html_text.extract_text(pages.limit(0)).collect() == []


# Shards


def check_shards(docs, rows):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.get(k, 0) for k in range(8)) <= 1
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
    expected = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected


def test_shards(sample, edge_docs, empty_docs):
    sharded = sharding.shuffle_into_shards(sample, bucket_bytes=20_000)
    rows = sharding.shard_digests(sharded).collect()
    check_shards(sample.collect(), rows)
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard_digests(sharding.shuffle_into_shards(sample, bucket_bytes=20_000)).collect()))
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert order != sorted(order)
    check_shards(edge_docs.collect(), sharding.shard_digests(sharding.shuffle_into_shards(edge_docs, n_buckets=3)).collect())
    assert sharding.shuffle_into_shards(empty_docs).collect() == []
    assert set(sharding.shuffle_into_shards(edge_docs).select("row.*").columns) == set(edge_docs.columns)
    plan = sharded._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_rows_spread_over_buckets(spark, monkeypatch):
    """A third of all rows are one row; all rows stay, and so do rows that differ in other columns or in nulls only."""
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(1, "same", None, {"k": 1})] * 100 + [(1, "same", "x", {"k": 2})] * 60 + [(None, None, None, None)] * 50 + [(k, f"t{k}", "y", {"k": k}) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, extra map<string,int>")
    sharded = sharding.shuffle_into_shards(docs, bucket_bytes=1024)
    got = sharded.select("row.*", "shard", "slot").collect()
    key = lambda r: str((r[0], r[1], r[2], r[3]))
    assert sorted(map(key, got)) == sorted(map(key, rows))
    places = sorted(8 * r.slot + r.shard for r in got)
    assert places == list(range(300))
    at = [8 * r.slot + r.shard for r in got if (r.text, r.lang) == ("same", None)]
    assert min(at) < 60 and max(at) > 240 and len(set(k // 60 for k in at)) == 5
    again = sharding.shuffle_into_shards(docs, bucket_bytes=1024).select("row.*", "shard", "slot").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_shards_are_written_in_order(spark, sample, tmp_path):
    sharded = sharding.shuffle_into_shards(sample)
    sharding.write_shards(sharded, f"{tmp_path}/out", rows_per_file=10)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == sample.count() and back.select("shard").distinct().count() == 8


# Media


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x12\xff\x00\x34\xff\xd9"
BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + bytes(40)
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8, b"mdat")


def test_sniffing_finds_valid_files_only():
    wav = media.to_wav(b"1234")
    for data, kind in ((png(), "image/png"), (GIF, "image/gif"), (JPEG, "image/jpeg"), (BMP, "image/bmp"), (MP4, "video/mp4"), (wav, "audio/wav")):
        assert media.sniff(data + b"tail") == [(0, len(data), kind)]
        assert media.sniff(b"pad: " + data) == [(5, len(data), kind)]
        assert media.sniff(data[:-1]) == []
    assert media.sniff(png().replace(b"IDAT", b"IDAX")) == []
    assert media.sniff(b"BM, GIF89a, RIFF, OggS and ftyp are only words") == []
    inner = media.to_wav(b"ab" + png() + b"cd")
    assert media.sniff(inner) == [(0, len(inner), "audio/wav"), (46, len(png()), "image/png")]


def ogg_page(flags, serial, body=b"x"):
    return b"OggS\0" + bytes([flags]) + bytes(8) + struct.pack("<I", serial) + bytes(8) + bytes([1, len(body)]) + body


def test_lengths_of_boxes_and_streams():
    ftyp, free = MP4[:16], struct.pack(">I4s", 12, b"free") + b"abcd"
    wide = struct.pack(">I4sQ", 1, b"mdat", 20) + b"data"
    assert media.sniff(ftyp + wide + free) == [(0, 48, "video/mp4")]
    assert media.sniff(ftyp + struct.pack(">I4s", 0, b"mdat") + b"to the end") == [(0, 34, "video/mp4")]
    assert media.sniff(ftyp + free[:-1]) == media.sniff(ftyp + wide[:-1]) == media.sniff(ftyp + wide[:12]) == []
    assert media.sniff(ftyp + free + b"some words after it") == [(0, 28, "video/mp4")]
    two = ogg_page(2, 1) + ogg_page(2, 2) + ogg_page(4, 1) + ogg_page(0, 2) + ogg_page(4, 2)
    assert media.sniff(two + b"tail")[0] == (0, len(two), "application/ogg")
    assert media.sniff(two[:-1]) == [] or media.sniff(two[:-1])[0][0] != 0
    chained = two + ogg_page(2, 3) + ogg_page(4, 3)
    assert media.sniff(chained)[0] == (0, len(chained), "application/ogg")


def test_embedded_files_are_carved(spark):
    rows = [(1, b"ab" + png() + b"cd" + GIF, "mine"), (2, GIF, "x"), (3, None, None), (4, b"", "y"), (1, b"ab" + png() + b"cd" + GIF, "mine")]
    df = spark.createDataFrame(rows, "k int, media binary, payload string").selectExpr("*", "'image/gif' as declared", "k as carved", "k as sniffed")
    seen = media.sniff_media(df)
    assert seen.columns == [*df.columns, "sniffed_", "payload_"] and [r.payload for r in seen.where("k = 2").collect()] == ["x"]
    got = media.carve_media(seen, found_col="sniffed_").orderBy("carved_.place").collect()
    assert [(r.k, r.carved, r.carved_.type, bytes(r.carved_.bytes)) for r in got] == [(1, 1, "image/png", png())] * 2 + [(1, 1, "image/gif", GIF)] * 2
    assert media.carve_media(seen.limit(0), found_col="sniffed_").collect() == []


def test_types_are_corrected(spark):
    rows = [(1, png(), "image/jpeg"), (2, b"words", "text/plain"), (3, b"words", "image/png"), (4, None, "image/png"), (5, b"", None), (6, b"x" + GIF, None)]
    got = {r.k: r for r in media.sniff_media(spark.createDataFrame(rows, "k int, media binary, declared string")).collect()}
    assert [(got[k].sniffed.type, got[k].sniffed.corrected) for k in range(1, 7)] == [
        ("image/png", True), ("text/plain", False), (None, True), (None, True), (None, False), (None, False)]
    assert got[6].sniffed.embedded[0].asDict() == {"offset": 1, "length": len(GIF), "type": "image/gif"}


def test_stored_texts_read_back(edge_docs, empty_docs, sample):
    for docs in (sample, edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"])):
        text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
        for r in media.media_digests(media.store_texts(docs)).collect():
            raw = text[r.doc_id]
            payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
            assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest()
            assert r.media_bytes == len(payload) + 44 and r.feature.startswith("audio/wav;")
    assert media.media_digests(media.store_texts(edge_docs)).count() == edge_docs.count()
    assert media.media_digests(media.store_texts(empty_docs)).collect() == []


@pytest.mark.parametrize("unit", ['<a ">"', '<a "', "<a '>", "<a '\">", "<p class=x ", "</a '"])
def test_quotes_take_linear_time(unit):
    began = time.time()
    html_text.main_text(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 10


@pytest.mark.parametrize("data", [
    (b"OggS" + b"\0" * 23) * 40_000, b"".join(b"OggS\0\2" + b"\0" * 8 + k.to_bytes(4, "little") + b"\0" * 9 for k in range(40_000)),
    (b"GIF89a" + b"\0" * 7 + b"!\0\x0f") * 60_000])
def test_heads_in_a_row_take_linear_time(data):
    began = time.time()
    media.sniff(data)
    assert time.time() - began < 5


def brute_main_text(source):
    """Densities, their sums and the core by the definitions, node by node, over the same tree."""
    page = html_text._Page(source)
    dead = page._dead()
    live = [k for k in range(len(page.names)) if not dead[k]]
    ancestors = lambda k: [] if page.parents[k] < 0 else [page.parents[k], *ancestors(page.parents[k])]
    inside = {k: [j for j in range(len(page.names)) if j == k or k in ancestors(j)] for k in live}
    body = next((k for k in live if page.names[k] == "body"), 0)
    chars, links = ({k: sum(own[j] for j in inside[k]) for k in live} for own in (page.own_chars, page.own_links))
    share = links[body] / max(chars[body], 1)
    density = {k: page.density(k, share) for k in live}
    for k in live:
        assert (page.chars[k], page.link_chars[k]) == (chars[k], links[k]) and page.tags[k] >= len(inside[k]) - 1
    sums = {k: sum(density[j] for j in live if page.parents[j] == k and page.names[j] in html_text.BLOCKS) for k in live}
    within = [k for k in live if k in inside[body]]
    core = max(within, key=lambda k: (sums[k], density[k], -k))
    path = [core, *[a for a in ancestors(core) if a in inside[body] or a == body]] if core != body else [core]
    whole = [k for k in path if page.names[k] in ("article", "main") and density[k] >= density[body]]
    if whole:
        return page.text_of([whole[-1]], dead)
    if core == body:
        return page.text_of([body], dead)
    threshold = min(density[k] for k in path)
    chosen = [k for k in within if k == core or page.parents[k] in path[1:] and k not in path and density[k] >= threshold and page.names[k] in html_text.BLOCKS]
    return page.text_of(sorted(chosen), dead)


def test_densities_by_brute_force(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(40).collect()]
    plain = [p.replace("<article", "<div").replace("</article", "</div").replace("<main", "<div").replace("</main", "</div") for p in pages]
    sparse = "<body><div>" + "<p>words of the core, many of them, in a row</p>" * 5 + "</div><article><b>a</b><i>b</i><b>c</b></article></body>"
    for source in [*pages, *plain, sparse]:
        assert html_text.main_text(source) == brute_main_text(source)
    assert "words of the core" in html_text.main_text(sparse)
