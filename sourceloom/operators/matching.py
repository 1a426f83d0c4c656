"""Texts that share runs of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import word_runs
from ..scratch import cut_lineage


#: A run that more texts of the left side have than this is dealt to several tasks.
HEAVY = 10_000
#: Heavy runs up to this number are broadcast (about 100 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 50_000


def shared_runs(left: DataFrame, left_id: str, right: DataFrame, right_id: str, text_col: str = "text", n: int = rules.COPY_WORDS, heavy: int = HEAVY) -> DataFrame:
    """Pairs of ids whose texts share runs of n words, and how many; a run counts once for each text.

    Runs of the left side are counted first. Rows of a run with more than `heavy` texts are dealt to as many parts as it has times that
    number, and the right side's rows of the run are repeated for each part; so no run makes a task much larger than `heavy` rows.
    """
    runs_of = lambda df, key: df.select(key, F.explode(word_runs(F.col(text_col), n)).alias("run"))
    ours, theirs = runs_of(left, left_id), runs_of(right, right_id)
    counted = cut_lineage(ours.groupBy("run").agg(F.count("*").alias("_n")).where(F.col("_n") > heavy))
    many = counted.count()
    if not many:
        return ours.join(theirs, "run").groupBy(left_id, right_id).agg(F.count("*").alias("shared"))
    split = counted.select("run", F.ceil(F.col("_n") / heavy).cast("int").alias("_parts"))
    split = F.broadcast(split) if many <= MOST_BROADCAST else split
    parts = F.coalesce("_parts", F.lit(1))
    ours = ours.join(split, "run", "left").select(left_id, "run", F.pmod(F.xxhash64(left_id), parts).cast("int").alias("_part"))
    theirs = theirs.join(split, "run", "left").select(right_id, "run", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return ours.join(theirs, ["run", "_part"]).groupBy(left_id, right_id).agg(F.count("*").alias("shared"))
