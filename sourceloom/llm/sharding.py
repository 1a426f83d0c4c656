"""A global random order by a two-pass external shuffle, dealt out to shards.

Pass one scatters the rows uniformly into memory-sized buckets by a seeded hash. Pass two shuffles each
bucket in memory (Fisher-Yates, Spark's `shuffle` of an array). The buckets in a row are the global order;
row p of it is row p div n of shard p mod n, so shards differ by one row at most and slots have no gaps.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: Buckets whose row counts are summed together before the sums are summed.
GROUP = 1024
#: Tasks of the second pass at most; with more buckets a task shuffles several, one after the other.
MOST_TASKS = 100_000
#: Repeated rows up to so many distinct ones are broadcast as their digests (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 50_000
#: The first places of so many buckets are broadcast (16 bytes each); of more they are joined by a shuffle.
MOST_PLACES = 1_000_000
#: Copies of a repeated row that one task writes out.
COPIES = 10_000


def shuffle_into_shards(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8, seed: int = 17,
    bucket_bytes: int = 16 << 20, n_buckets: int | None = None,
) -> DataFrame:
    """row (a struct of all columns of df), shard and slot of every row.

    The law is `rows`: shards hold equally many rows or one more. Buckets are sized by the bytes of all texts
    unless n_buckets is given; a row's bucket depends on all its columns and the seed. Rows equal in all columns share a
    bucket while their texts together stay under a quarter of bucket_bytes; beyond that they are counted, and their copies get
    numbers and spread by them. Null ids and texts are rows like others; an empty table gives none; texts of any length
    stay whole; df's columns are inside the struct, so their names cannot clash. In a bucket rows are sorted by digests of all
    their columns before they are shuffled, and buckets are in order within a task, so a task that runs again gives the same order.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    columns = [F.col(f"`{c}`") for c in df.columns]
    # maps have no hash; nulls leave a hash as it is, so which columns are null is hashed beside them
    hashed = [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(columns, df.schema)]
    hashed.append(F.array(*[c.isNull() for c in columns]))
    digests = [F.xxhash64(F.lit(seed + k), *hashed).alias(f"h{k}") for k in (0, 1)]
    rows = df.select(*digests, (F.octet_length(text) + 64).alias("size"), F.struct(*columns).alias("row"))

    counted = cut_lineage(rows.groupBy("h0", "h1").agg(F.count("*").alias("count"), F.max("size").alias("size")))
    total = counted.agg(F.sum(F.col("size") * F.col("count"))).first()[0] or 0
    if n_buckets is None:
        n_buckets = 1 << max(0, -(-total // bucket_bytes) - 1).bit_length()
    bucket = F.pmod("h0", F.lit(n_buckets)).alias("bucket")
    many = (F.col("count") > 1) & (F.col("size") * F.col("count") > bucket_bytes / 4)
    repeated = counted.where(many).select("h0", "h1")
    n_repeated = repeated.count()
    places = counted.where(~many).select(bucket, "count")
    if n_repeated:
        repeated = F.broadcast(repeated) if n_repeated <= MOST_BROADCAST else repeated
        own = rows.join(repeated, ["h0", "h1"], "left_semi").groupBy("h0", "h1", F.to_json("row").alias("json"))
        own = cut_lineage(own.agg(F.first("row").alias("row"), F.count("*").alias("count")).drop("json"))
        copies = own.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(count - 1) div {COPIES}"))).alias("part"))
        copies = copies.repartition("h0", "h1", "part")
        copy = F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("part") * COPIES + COPIES, "count") - 1))
        copies = copies.select("h0", "h1", "row", copy.alias("copy")).select(
            F.xxhash64(F.lit(seed), "h0", "copy").alias("h0"), F.xxhash64(F.lit(seed), "h1", "copy").alias("h1"), "row")
        places = places.unionByName(copies.select(bucket, F.lit(1).cast("long").alias("count")))
        rows = rows.join(repeated, ["h0", "h1"], "left_anti").select("h0", "h1", "row").unionByName(copies)

    counts = places.groupBy("bucket").agg(F.sum("count").alias("count")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    inner = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("group").agg(F.sum("count").alias("rows"))
    outer = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # one row per GROUP buckets
    groups = groups.select("group", F.coalesce(F.sum("rows").over(outer), F.lit(0)).alias("before"))
    within = counts.select("bucket", "group", F.coalesce(F.sum("count").over(inner), F.lit(0)).alias("inside"))
    first = within.join(groups, "group").select("bucket", (F.col("before") + F.col("inside")).alias("first"))

    # a task per bucket, or several whole buckets in a task, however large the table is
    tasks = min(n_buckets, MOST_TASKS)
    scattered = rows.select(bucket, F.struct("h1", "h0", "row").alias("item")).withColumn("task", F.pmod("bucket", F.lit(tasks)).cast("int"))
    filled = scattered.repartitionById(tasks, "task").groupBy("task", "bucket").agg(F.collect_list("item").alias("items"))
    first = F.broadcast(first) if n_buckets <= MOST_PLACES else first
    filled = filled.join(first, "bucket").sortWithinPartitions("bucket")
    before = lambda a, b: F.when(a["h1"] < b["h1"], -1).when(a["h1"] > b["h1"], 1).when(a["h0"] < b["h0"], -1).when(a["h0"] > b["h0"], 1).otherwise(0)
    shuffled = filled.select("first", F.shuffle(F.array_sort("items", before), seed).alias("items"))
    placed = shuffled.select("first", F.posexplode("items").alias("k", "item"))
    place = F.col("first") + F.col("k")
    return placed.select(
        F.col("item.row").alias("row"), (place % n_shards).cast("int").alias("shard"), F.floor(place / n_shards).cast("long").alias("slot")
    )


def shard_digests(sharded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is not `key`) of sharded rows.

    A null text has size 1 and the checksum of the empty text; a null id stays null; repeated rows give a row each; an
    empty table gives none. Long texts count whole. Other columns stay inside `row`, so their names cannot clash.
    """
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    return sharded.select(
        F.col(f"row.`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str, n_shards: int = 8, rows_per_file: int = 1_000_000) -> None:
    """Write a Parquet folder per shard, its rows in the order of their slots within and across files.

    Rows stay as shuffle_into_shards gives them: null ids, null, empty and long texts and repeats are written like others, and columns
    of any name are inside `row`. An empty table writes no files of rows.
    """
    part = F.floor(F.col("slot") / rows_per_file)
    out = sharded.withColumn("part", part).repartition("shard", "part").sortWithinPartitions("shard", "part", "slot")
    out.write.partitionBy("shard", "part").parquet(path)
