"""Line ranges inside one another."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Around:
    """The ranges seen so far that may still be the smallest around a later one: ends rise, spans never fall."""

    def __init__(self):
        self.ends: list[int] = []
        self.starts: list[int] = []

    def find(self, end: int) -> tuple[int | None, int | None]:
        k = bisect_left(self.ends, end)
        return (self.starts[k], self.ends[k]) if k < len(self.ends) else (None, None)

    def add(self, start: int, end: int) -> None:
        """A range that begins no earlier than all before; those that end no later and are longer are of no more use."""
        stop = bisect_left(self.ends, end + 1)
        k = stop
        while k and self.ends[k - 1] - self.starts[k - 1] > end - start:
            k -= 1
        if stop < len(self.ends) and self.ends[stop] - self.starts[stop] < end - start:
            return
        self.ends[k:stop], self.starts[k:stop] = [end], [start]


def containment(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """parent_start and parent_end (the smallest other range of the same keys around each range, of equal ones the first; null without
    one) and is_container. ranges has start_line and end_line, not null; equal ranges of the same keys count once.

    Ranges are sorted by keys, start and falling end, and swept once: whatever is around a range comes before it. Only the ranges that may be
    around later ones are held, so a file takes time in proportion to its ranges, apart from the sort.
    """
    own = ranges.select(*keys, F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line")).distinct()
    n_keys = len(keys)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, around = None, _Around()
        for batch in batches:
            starts, ends = batch.column(n_keys).to_pylist(), batch.column(n_keys + 1).to_pylist()
            owners, found = zip(*[c.to_pylist() for c in batch.columns[:n_keys]]), []
            for owner, start, end in zip(owners, starts, ends):
                if owner != at:
                    at, around = owner, _Around()
                found.append(around.find(end))
                around.add(start, end)
            parents = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *parents], names=[*batch.schema.names, "parent_start", "parent_end"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", parent_start long, parent_end long"
    ordered = own.repartition(*keys).sortWithinPartitions(*keys, "start_line", F.desc("end_line"))
    parents = ordered.mapInArrow(sweep, schema)
    containers = parents.where("parent_start is not null").select(*keys, F.col("parent_start").alias("start_line"), F.col("parent_end").alias("end_line"), F.lit(True).alias("c")).distinct()
    return parents.join(containers, [*keys, "start_line", "end_line"], "left").withColumn("is_container", F.coalesce("c", F.lit(False))).drop("c")
