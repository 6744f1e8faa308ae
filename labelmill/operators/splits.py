"""Deterministic splits that keep groups together.

Membership depends on an order of the units. The scalable mode orders by a seeded hash; the exact mode takes the order that
a seeded shuffle on the driver gives, over places and sizes alone. Running totals are taken over units by a two-level sum, so no single task sees all
of them: totals within ranges of the order are added to the totals of the ranges before.
"""

from __future__ import annotations

import random
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.operators.batches import numbered
from labelmill.sources.digests import ordered_digest
from labelmill.storage import staged

#: The hash order is cut in so many ranges by its first characters.
RANGE_CHARS = 3


def units(records: DataFrame, id_col: str = "id", group_col: str = "paraphrase_group_id", ord_col: str = "ord", carry: list[str] | None = None) -> DataFrame:
    """(unit, size, first_ord, ...): records of a group are one unit, one without a group is its own. Carried columns are those of a unit's first record."""
    unit = F.coalesce(F.concat(F.lit("g:"), F.col(group_col)), F.concat(F.lit("r:"), F.col(id_col)))
    first = [F.min_by(c, ord_col).alias(c) for c in carry or []]
    return records.withColumn("unit", unit).groupBy("unit").agg(F.count(F.lit(1)).alias("size"), F.min(ord_col).alias("first_ord"), *first)


def hash_order(seed: int, unit: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), unit))


def _before(ranked: DataFrame, by: list[str]) -> DataFrame:
    """ranked (key, size, ...) with before, the sizes that come earlier in the order of key (within by), and total."""
    ranged = ranked.withColumn("range", F.substring("key", 1, RANGE_CHARS))
    sums = ranged.groupBy(*by, "range").agg(F.sum("size").alias("in_range"))
    # as many rows as ranges: at most 16 ** RANGE_CHARS for each value of by
    over = Window.partitionBy(*by).orderBy("range")
    sums = sums.withColumn("start", F.sum("in_range").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_range")).withColumn("total", F.sum("in_range").over(Window.partitionBy(*by)))
    inner = Window.partitionBy(*by, "range").orderBy("key", "unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = ranged.withColumn("upto", F.sum("size").over(inner))
    joined = within.join(sums, [*by, "range"])
    return joined.withColumn("before", F.col("start") + F.col("upto") - F.col("size")).drop("range", "start", "upto", "in_range")


def _target(total: Column, ratio: float) -> Column:
    """At least one record, even for ratio 0."""
    return F.greatest(F.lit(1), F.floor(total * F.lit(ratio))).cast("long")


def greedy(ranked: DataFrame, val_ratio: float, test_ratio: float, by: list[str] | None = None) -> DataFrame:
    """ranked (unit, key, size) with split: units fill test, then val, then train; a unit may go over the target."""
    by = by or []
    placed = _before(ranked, by).withColumn("in_test", F.col("before") < _target(F.col("total"), test_ratio))
    tests = placed.where("in_test").groupBy(*by).agg(F.sum("size").alias("tested"))
    placed = placed.join(tests, by) if by else placed.withColumn("tested", tests.scalar())
    split = F.when(F.col("in_test"), "test").when(F.col("before") - F.col("tested") < _target(F.col("total"), val_ratio), "val").otherwise("train")
    return placed.withColumn("split", split).drop("in_test", "tested", "before", "total")


def split_records(records: DataFrame, val_ratio: float = 0.1, test_ratio: float = 0.1, seed: int = 42, stratify_by: str | None = None) -> DataFrame:
    """records with split, in the order of a seeded hash of units; with stratify_by each value is split by itself."""
    carry = [stratify_by] if stratify_by else []
    ranked = units(records, carry=carry)
    if stratify_by:
        ranked = ranked.withColumn(stratify_by, F.coalesce(stratify_by, F.lit("_unknown")))
    placed = greedy(ranked.withColumn("key", hash_order(seed, F.col("unit"))), val_ratio, test_ratio, carry)
    unit = F.coalesce(F.concat(F.lit("g:"), F.col("paraphrase_group_id")), F.concat(F.lit("r:"), F.col("id")))
    return records.withColumn("unit", unit).join(placed.select("unit", "split"), "unit").drop("unit")


#: Rows of a table that is written from numbers on the driver, at once.
SLICE = 1 << 20


def _written(spark: SparkSession, name: str, columns: dict[str, np.ndarray]) -> DataFrame:
    """Columns of numbers as a table in the shared folder, written slice by slice."""
    n = len(next(iter(columns.values())))
    parts = [pa.table({k: v[lo : lo + SLICE] for k, v in columns.items()}) for lo in range(0, max(n, 1), SLICE)]
    first = staged(spark.createDataFrame(parts[0]), name)
    for part in parts[1:]:
        spark.createDataFrame(part).write.mode("append").parquet(first.staged_at)
    out = spark.read.schema(first.schema).parquet(first.staged_at)
    out.staged_at = first.staged_at
    return out


def _shuffled(n: int, rng: random.Random) -> np.ndarray:
    """What a seeded shuffle puts at each of n places."""
    places = array("q", range(n))
    rng.shuffle(places)
    return np.frombuffer(places, np.int64) if n else np.zeros(0, np.int64)


SPLITS = ("train", "val", "test")


def split_records_exactly(records: DataFrame, val_ratio: float = 0.1, test_ratio: float = 0.1, seed: int = 42, stratify_by: str | None = None, ord_col: str = "ord", group_col: str = "paraphrase_group_id", ordered: bool = False) -> DataFrame:
    """records with split in the order of Python's seeded shuffle of units in order of appearance; with ordered also position, the record's place in its split.

    Such a shuffle is one sequence of random numbers, so it is made on the driver: over places, with one number, the size,
    for each unit (and, for positions of stratified splits, which are shuffled once more with the next seed, one for each
    record). Names and rows stay where they are: what the driver finds is written as a table of the new places and joined.
    Membership and order equal those of a shuffle in one process. ord_col must be unique; a record without a group is a unit
    by itself, even if others have its id.
    """
    spark = records.sparkSession
    bucket = F.coalesce(F.col(stratify_by).cast("string"), F.lit("_unknown")) if stratify_by else F.lit("")
    keys = records.select(F.col(ord_col).alias("_ord"), F.concat(F.lit("g:"), F.col(group_col)).alias("group"), bucket.alias("bucket"))
    placed = numbered(keys, ["_ord"], name="place").withColumn("unit", F.coalesce("group", F.concat(F.lit("r:"), F.col("place").cast("string"))))
    found = placed.groupBy("unit").agg(F.count(F.lit(1)).alias("size"), F.min("place").alias("first"), F.min_by("bucket", "place").alias("bucket"))
    ranked = staged(numbered(found, ["bucket", "first"]).select("rn", "bucket", "unit", "size"), "units")
    # a row for each bucket
    edges = ranked.groupBy("bucket").agg(F.min("rn").alias("lo"), F.count(F.lit(1)).alias("n")).orderBy("lo").collect()
    table = ranked.select("rn", "size").toArrow()
    sizes = np.zeros(table.num_rows, np.int64)
    sizes[table.column("rn").to_numpy()] = table.column("size").to_numpy()
    code, start = np.zeros(len(sizes), np.int8), np.zeros(len(sizes), np.int64)
    filled = [0, 0, 0]
    for e in edges:
        order = e["lo"] + _shuffled(e["n"], random.Random(seed))
        size = sizes[order]
        total = int(size.sum())
        # units fill test until its room is reached, then val; what goes over stays
        before = np.cumsum(size) - size
        in_test = before < max(1, int(total * test_ratio))
        tested = int(size[in_test].sum())
        in_val = ~in_test & (before - tested < max(1, int(total * val_ratio)))
        for k, inside in enumerate((~in_test & ~in_val, in_val, in_test)):
            code[order[inside]] = k
            start[order[inside]] = filled[k] + np.cumsum(size[inside]) - size[inside]
            filled[k] += int(size[inside].sum())
    of_unit = ranked.select("rn", "unit").join(_written(spark, "places", {"rn": np.arange(len(sizes)), "code": code, "start": start, "base": np.cumsum(sizes) - sizes}), "rn")
    split = F.get(F.array(*map(F.lit, SPLITS)), F.col("code").cast("int")).alias("split")
    inside = placed.select("_ord", "place", "unit").join(of_unit, "unit")
    if not ordered:
        return records.join(inside.select(F.col("_ord").alias(ord_col), split), ord_col)
    # the records of a unit stand together, in their own order
    at = numbered(inside.select("_ord", "place", "rn", "code", "start", "base"), ["rn", "place"], name="at")
    chosen = at.select("_ord", "code", (F.col("start") + F.col("at") - F.col("base")).alias("position"))
    if stratify_by:
        rng = random.Random(seed + 1)
        moves = []
        for k in range(len(SPLITS)):
            now = _shuffled(filled[k], rng)
            back = np.empty(len(now), np.int64)
            back[now] = np.arange(len(now))
            moves.append(back)
        table = _written(spark, "moves", {"code": np.repeat(np.arange(3, dtype=np.int8), filled), "position": np.concatenate([np.arange(n) for n in filled]), "moved": np.concatenate(moves)})
        chosen = chosen.join(table, ["code", "position"]).drop("position").withColumnRenamed("moved", "position")
    return records.join(chosen.select(F.col("_ord").alias(ord_col), split, "position"), ord_col)


def split_digests(ordered: DataFrame, id_col: str = "id") -> DataFrame:
    """(split, n, checksum): SHA-256 of the ids of each split in the order of position, with line feeds between."""
    rows = [(name, *ordered_digest(ordered.where(F.col("split") == name), ["position"], id_col)) for name in SPLITS]
    return ordered.sparkSession.createDataFrame(rows, "split string, n long, checksum string")


def kept_split(records: DataFrame, path: str, id_col: str = "id", **how) -> DataFrame:
    """records with the split that was written at path; if there is none yet, it is made and written first. Records that it hasn't are left out, so membership stays as it was."""
    from labelmill.plans.manifest import materialised

    spark = records.sparkSession
    saved = materialised(path, lambda: split_records(records, **how).select(id_col, "split"), spark)
    return records.join(saved, id_col)


def masked(records: DataFrame, mask: DataFrame, id_col: str = "id") -> DataFrame:
    """Records whose id the mask has."""
    return records.join(mask.select(F.col(id_col)).distinct(), id_col, "left_semi")


def orphans(mask: DataFrame, records: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids of the mask that no record has."""
    return mask.select(id_col).distinct().join(records.select(id_col), id_col, "left_anti")


def split_then_mask(records: DataFrame, mask: DataFrame | None, **how) -> DataFrame:
    """First split, then keep the mask's ids, last drop records without a label: this order fixes the membership."""
    split = split_records(records, **how)
    if mask is not None:
        split = masked(split, mask)
    return split.where(F.coalesce("instruction_set", F.lit("")) != "")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it is empty."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df
