"""A mix of sources by target weights: entropy balancing of rates, rounded into whole copies.

Every document gets a rate, how often the mix takes it. Among all rates that meet a token constraint for each source, those of least
relative entropy to 1 are wanted, where a document's entropy counts as its size over its log-size x = log2(1 + size). They are
min(most, exp(lambda * x)) with one multiplier lambda a source, the root of the convex dual's gradient. All sources are solved at once by Newton's
method inside a bracket: an iteration is one aggregation over the histogram of (source, size). All sums are of integers, so that reruns agree.

Rates are rounded along each source's documents in the order of size: document k gets floor(R_k) - floor(R_{k-1}) copies of the running sum R of
rates, so errors of neighbours cancel and a source misses its target by less than its longest document. What it misses is then taken from, or
added to, single copies of its smallest documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import cut_lineage

#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: Rates are integers in units of this.
UNIT = 1 << 24
#: Log-sizes are integers in units of this where they are summed.
FINE = 1 << 16
#: Cells (pairs of source and size) up to this number are broadcast, about 60 bytes each; more are joined by a shuffle.
MOST_BROADCAST = 300_000
#: Bisection alone would end by then; Newton's steps usually end after six.
MOST_STEPS = 100


def _exact(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(38,0)")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Adds target to sources (source, source_size): the whole size, shared by weight, but at most `most` times a source's size.

    The weights repeat along the sources in the order of code points, null last. The excess of sources at their limit is shared by weight among the
    others until none is above: the level theta (tokens a unit of weight) rises until sources with most * size <= theta * weight stay the same. No
    sources give none; if all are of size zero all targets are zero.
    """
    placed = numbered(sources, [], [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = cut_lineage(placed.select("source", "source_size", weight.cast("long").alias("weight")))
    total = placed.agg(F.sum(_exact("source_size"))).first()[0] or 0
    above, before = F.lit(False), -1
    while True:
        free, units, shut = placed.select(above.alias("shut"), "weight", "source_size").agg(
            F.lit(total).cast("decimal(38,0)") - F.coalesce(F.sum(F.when(F.col("shut"), _exact("source_size") * most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~F.col("shut"), F.col("weight"))), F.lit(0)), F.count_if("shut")).first()
        if shut == before or not units:
            break
        before = shut
        level = (F.lit(str(free)).cast("decimal(38,0)"), F.lit(units).cast("decimal(38,0)"))
        above = _exact("source_size") * most * level[1] <= level[0] * F.col("weight")
    share = F.lit(float(free)) * F.col("weight") / F.lit(float(units or 1))
    return placed.withColumn("target", F.when(above | F.lit(not units), (F.col("source_size") * most).cast("double")).otherwise(share))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _rate(multiplier: Column, log_size: Column, most: int) -> Column:
    return F.floor(F.least(F.lit(float(most)), F.exp(multiplier * log_size)) * UNIT).cast("long")


def solve_rates(cells: DataFrame, targets: DataFrame, most: int = 3, tolerance: float = 1e-6) -> DataFrame:
    """source and multiplier for each source of targets, by Newton's method over cells (source, size, count).

    A source is done when it meets its target up to `tolerance` of it and two units of each rate. A source whose target is `most` times its size gets a multiplier that puts every rate at the limit. A source without words keeps the rate 1.
    """
    log_size = F.log2(F.col("size") + F.lit(1.0))
    cells = cells.where("size > 0").select("source", "size", "count", log_size.alias("x"), F.floor(log_size * FINE).cast("long").alias("x_fine"))
    words = _exact(F.col("size")) * F.col("count")
    means = cells.groupBy("source").agg((F.sum(words * F.col("x_fine")).cast("double") / F.sum(words).cast("double") / FINE).alias("x"))
    full = F.col("target") >= F.col("source_size") * most
    start = F.when(F.col("t.source_size") == 0, 0.0).when(full, 1e6).otherwise(F.ln(F.col("t.target") / F.col("t.source_size")) / F.col("m.x"))
    state = targets.alias("t").join(means.alias("m"), _same("t", "m"), "left").select(
        "t.source", "t.target", (F.col("t.target") * tolerance + F.col("t.source_size") * (2.0 / UNIT)).alias("near"), start.alias("multiplier"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        (full | (F.col("t.source_size") == 0)).alias("done"))
    state = cut_lineage(state)
    for _ in range(MOST_STEPS):
        if state.where("not done").isEmpty():
            break
        at = cells.alias("c").join(state.where("not done").alias("s"), _same("c", "s")).select(
            "s.source", "c.x_fine", (_exact("c.size") * F.col("c.count")).alias("words"), _rate(F.col("s.multiplier"), F.col("c.x"), most).alias("rate"))
        sums = at.groupBy("source").agg(
            (F.sum(F.col("words") * F.col("rate")).cast("double") / UNIT).alias("taken"),
            (F.coalesce(F.sum(F.when(F.col("rate") < most * UNIT, F.col("words") * F.col("rate") * F.col("x_fine"))), F.lit(0)).cast("double") / UNIT / FINE).alias("slope"))
        both = state.alias("s").join(sums.alias("g"), _same("s", "g"), "left")
        over = F.col("g.taken") - F.col("s.target")
        low = F.when(over <= 0, F.greatest("s.low", "s.multiplier")).otherwise(F.col("s.low"))
        high = F.when(over > 0, F.least("s.high", "s.multiplier")).otherwise(F.col("s.high"))
        stepped = both.select(
            "s.source", "s.target", "s.near", "s.multiplier", low.alias("low"), high.alias("high"), F.try_subtract("s.multiplier", F.try_divide(over, "g.slope")).alias("newton"),
            (F.col("s.done") | F.coalesce(F.abs(over) <= F.col("s.near"), F.lit(False))).alias("done"))
        outward = F.when(F.col("high").isNull(), F.col("low") + 1.0).when(F.col("low").isNull(), F.col("high") - 1.0).otherwise((F.col("low") + F.col("high")) / 2)
        fits = (F.col("newton") > F.coalesce("low", F.lit(float("-inf")))) & (F.col("newton") < F.coalesce("high", F.lit(float("inf"))))
        then = F.when(F.col("done"), F.col("multiplier")).when(fits, F.col("newton")).otherwise(outward)
        narrow = F.coalesce(F.col("high") - F.col("low") < 1e-12, F.lit(False))
        state = cut_lineage(stepped.select("source", "target", "near", then.alias("multiplier"), "low", "high", (F.col("done") | narrow).alias("done")))
    return state.select("source", "multiplier")


def _planned(cells: DataFrame, targets: DataFrame, multipliers: DataFrame, most: int, seed: int) -> DataFrame:
    """cells with rate, begin (the running sum of rates before the cell, shifted by the source's own start) and quota.

    quota: how many documents of the cell give up a copy (negative) or get one more (positive), the smallest sizes first.
    """
    rated = cells.alias("c").join(targets.alias("t"), _same("c", "t")).join(multipliers.alias("m"), _same("c", "m")).select(
        "c.*", "t.source_size", "t.target", _rate(F.col("m.multiplier"), F.log2(F.col("c.size") + F.lit(1.0)), most).alias("rate"))
    # rows of a source here are its distinct sizes, at most the square root of twice its words
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(UNIT))
    begun = rated.withColumn("begin", F.coalesce(F.sum(F.col("rate") * F.col("count")).over(along), F.lit(0)) + shift)
    copies = _copies_until(F.col("count"))
    whole = Window.partitionBy("source")
    missed = F.floor(F.col("target") - F.sum(_exact(copies) * F.col("size")).over(whole)).cast("long")
    begun = begun.withColumn("missed", missed)
    able = F.when(F.col("size") == 0, 0).otherwise(_able_until(F.col("count"), most))
    begun = begun.withColumn("able", able)
    spent = F.coalesce(F.sum(_exact("able") * F.col("size")).over(along), F.lit(0))
    left = F.greatest(F.abs(_exact("missed")) - spent, F.lit(0))
    quota = F.when(F.col("size") == 0, 0).otherwise(F.least(_exact("able"), F.floor(left / F.greatest("size", F.lit(1))))).cast("long")
    return begun.select("source", "size", "source_size", "target", "rate", "begin", (quota * F.signum("missed")).cast("long").alias("quota"))


def _copies_until(k: Column) -> Column:
    """Copies of the first k documents of a cell together."""
    return F.floor((F.col("begin") + F.col("rate") * k) / UNIT) - F.floor(F.col("begin") / UNIT)


def _able_until(k: Column, most: int) -> Column:
    """How many of the first k documents of a cell can get one more copy (missed > 0) or give one up (missed < 0)."""
    more = F.when(F.col("rate") > (most - 1) * UNIT, most * k - _copies_until(k)).otherwise(k)
    fewer = F.when(F.col("rate") < UNIT, _copies_until(k)).otherwise(k)
    return F.when(F.col("missed") > 0, more).when(F.col("missed") < 0, fewer).otherwise(F.lit(0))


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 29,
) -> DataFrame:
    """doc_id, source, size (words), source_size, target, copies and taken (copies * size) of every row of df.

    A null text has no words; a null source is a source, the last; texts without words get about as many copies as their rate 1 says and
    take nothing. Repeated rows are rows like others: which of them get the copies is not told apart. Null ids stay null; texts of any
    length count whole; other columns are not carried, so their names cannot clash; an empty table gives none. No document has more than
    `most` copies. The same table gives the same rows, however it is dealt out.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = cut_lineage(df.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")))
    cells = cut_lineage(docs.groupBy("source", "size").agg(F.count("*").alias("count")))
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"))
    targets = source_targets(sources, weights, most).select("source", "source_size", "target")
    targets = cut_lineage(targets)
    planned = cut_lineage(_planned(cells, targets, solve_rates(cells, targets, most), most, seed))
    few = planned.count() <= MOST_BROADCAST
    order = ["_hash", "doc_id", "_row"]
    rows = docs.select("*", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    ranked = numbered(rows, ["source", "size"], order, "k")
    both = ranked.alias("d").join(F.broadcast(planned).alias("p") if few else planned.alias("p"), _same("d", "p") & (F.col("d.size") == F.col("p.size")))
    both = both.select("d.doc_id", "d.source", "d.size", "d.k", "p.source_size", "p.target", "p.rate", "p.begin", "p.quota", F.signum("p.quota").alias("missed"))
    k = F.col("k")
    copies = _copies_until(k) - _copies_until(k - 1)
    able = _able_until(k, most)
    changed = (able > _able_until(k - 1, most)) & (able <= F.abs("quota"))
    copies = (copies + F.when(changed, F.signum("quota")).otherwise(0)).cast("long")
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def write_mix(df: DataFrame, mixed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write df's rows as Parquet, each as often as mixed says; ids must be unique and not null, rows of no copies are left out.

    Columns of df stay as they are; rows whose id is null or missing in mixed are left out; an empty table writes no rows.
    """
    times = mixed.where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("copies").alias("_copies"))
    rows = df.join(times, F.col(f"`{id_col}`") == F.col("_id")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    rows.drop("_id", "_copies", "_copy").write.parquet(path)
