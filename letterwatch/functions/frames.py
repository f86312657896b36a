"""Frame-level helpers: skew-safe joins, exact order statistics, scratch space."""
from __future__ import annotations

import bisect
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

# No piece of a key holds more than 1/PIECES of all rows, and fewer than PIECES keys can be that large.
PIECES = 2048
# A per-key table is broadcast only if it was measured and has at most this many rows and bytes of text.
BROADCAST_KEYS = 200_000
BROADCAST_BYTES = 64 << 20
# A driver-supplied list is inlined into the plan up to this many entries; beyond it a join is used.
INLINE_LIMIT = 2000


def spread_join(facts: DataFrame, per_key: DataFrame, key, row_id: str = "mail_id", broadcast_keys: int = BROADCAST_KEYS,
                written: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Left join of a fact table with a table that is unique on ``key``, safe for hot keys.

    The per-key table is written once (unless the caller has ``written`` it) and measured.  If both its rows and its bytes are few it is broadcast and the facts
    are not shuffled at all.  Otherwise the facts are counted by key, whether or not the per-key table knows the key (null
    included), and a key that holds more than 1/PIECES of all facts is split into salted pieces; fewer than PIECES keys
    can be that large, so the list of them is always small enough to broadcast, and no task gets more than its share.
    A caller that has written the number of facts per key gives it as ``counts`` (the keys and ``_rows``), which saves a pass.
    """
    keys = [key] if isinstance(key, str) else list(key)
    per_key = per_key if written else materialize(per_key)
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in per_key.columns), F.lit(8))
    n_keys, n_bytes = per_key.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    if n_keys <= broadcast_keys and n_bytes <= BROADCAST_BYTES:
        return _null_safe_left(facts, F.broadcast(per_key), keys)
    counts = materialize(facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))) if counts is None else counts
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    hot = counts.where(F.col("_rows") * PIECES > total).select(*keys, F.ceil(F.col("_rows") * PIECES / F.lit(max(total, 1))).cast("int").alias("_pieces"))
    salted = (_null_safe_left(per_key, F.broadcast(hot), keys)
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces"))
    marked = _null_safe_left(facts, F.broadcast(hot), keys).withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(row_id), F.col("_pieces")), F.lit(0)).cast("int")).drop("_pieces")
    return _null_safe_left(marked, salted, keys + ["_salt"]).drop("_salt")


def _null_safe_left(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, "left").drop(*[f"_r_{k}" for k in keys])


def rolled(df: DataFrame, sets: dict[str, dict[str, Column] | list[str]], **aggregates: Column) -> dict[str, DataFrame]:
    """Several groupings of a frame in one scan: a frame of groups for each name in ``sets``, all read from one written table.

    A set lists columns, or names expressions; an empty one is the grand total.  One aggregation over GROUPING SETS, combined before
    the shuffle; a column of a group may be null, the sets are told apart by their grouping number.
    """
    named = {name: ({c: F.col(c) for c in keys} if not isinstance(keys, dict) else keys) for name, keys in sets.items()}
    keys = {k: e for one in named.values() for k, e in one.items()}
    rows = df.withColumns({f"_k_{k}": e for k, e in keys.items()}) if keys else df
    columns = [f"_k_{k}" for k in keys]
    if not columns:
        return {name: df.agg(*[a.alias(n) for n, a in aggregates.items()]) for name in sets}
    table = materialize(rows.groupingSets([[f"_k_{k}" for k in one] for one in named.values()], *columns).agg(
        F.grouping_id().alias("_set"), *[a.alias(n) for n, a in aggregates.items()]))
    number = {name: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in one) for name, one in named.items()}
    return {name: table.where(F.col("_set") == number[name]).select(*[F.col(f"_k_{k}").alias(k) for k in one], *aggregates)
            for name, one in named.items()}


def totalled(groups: DataFrame, count: str) -> tuple[DataFrame, Column]:
    """Groups, written once, and the sum of their counts as a scalar: the total of the rows without a second pass over them."""
    written = materialize(groups)
    return written, written.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).scalar()


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.when(whole > 0, part * 100.0 / whole).otherwise(0.0), digits)


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def arrival(time="time", mail="mail_id") -> Column:
    """Order of arrival as one fixed-width number (time, undated last, then mail number), so that its minimum is a hash aggregate."""
    at = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(2 ** 62)).cast("decimal(20,0)")
    return (at * _whole(2 * 10 ** 19) + F.col(mail).cast("decimal(20,0)") + _whole(2 ** 63)).cast("decimal(38,0)")


def arrived(packed) -> Column:
    """The mail number inside an ``arrival``."""
    return (F.pmod(F.col(packed), _whole(2 * 10 ** 19)) - _whole(2 ** 63)).cast("long")


def inline_values(df: DataFrame, column: str, limit: int = INLINE_LIMIT):
    """The distinct non-null values if there are at most ``limit``; otherwise None."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else [r[0] for r in rows]


def exact_quantile(df: DataFrame, column: str, q: float):
    """Exact linearly interpolated quantile of a numeric column, or None if there is no value.  Two scans (see ``around_rank``)."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    near, below, n = around_rank(values, "v", q, lambda n: [int(q * (n - 1)), min(n - 1, int(q * (n - 1)) + 1)])
    if not n:
        return None
    position = q * (n - 1)
    lower = int(position)
    low, high = values_at(near, "v", [lower - below, lower + (lower < position) - below])
    return low + (high - low) * (position - lower)


def values_at(df: DataFrame, column: str, ranks, small: int = 10_000) -> list:
    """The values with the given zero-based ranks: from one list if there are few distinct values, else by narrowing."""
    counts = df.groupBy(F.col(column).alias("v")).count().orderBy("v").limit(small + 1).collect()
    if len(counts) > small:
        return [value_at_rank(df, column, r) for r in ranks]
    upto, total = [], 0
    for row in counts:
        total += row["count"]
        upto.append(total)
    return [counts[bisect.bisect_right(upto, r)]["v"] for r in ranks]


def around_rank(df: DataFrame, column: str, q: float, ranks, accuracy: int = 10_000):
    """(rows near the wanted ranks, number of rows below them, number of all rows), in two scans.

    The first scan counts the rows and brackets the fraction ``q`` by a mergeable quantile sketch whose error is a share
    1/``accuracy`` of the rows; the second one writes the rows inside the bracket, about 4/``accuracy`` of all and ties, and counts
    those below.  ``ranks`` gives the zero-based ranks that must lie inside, from the number of rows; should the sketch have
    missed one, all rows count as near.  Nulls take no part.
    """
    v, off = F.col(column), 2.0 / accuracy
    n, bracket = df.agg(F.count(v), F.percentile_approx(v, [max(0.0, q - off), min(1.0, q + off)], accuracy)).first()
    if not n:
        return df, 0, 0
    seen = Observation()
    lo, hi = bracket
    near = materialize(df.observe(seen, F.count_if(v < lo).alias("below"), F.count_if(v.between(lo, hi)).alias("inside")).where(v.between(lo, hi)))
    below, inside = seen.get["below"], seen.get["inside"]
    if all(below <= r < below + inside for r in ranks(n)):
        return near, below, n
    return df, 0, n


def value_at_rank(df: DataFrame, column: str, rank: int, buckets: int = 4096, small: int = 10_000):
    """The value with the given zero-based rank of a numeric column, without sorting the data.

    Narrows a histogram around the rank.  A round is one aggregation with map-side combine into at most
    ``buckets`` rows; the range shrinks by that factor each time.
    """
    v = F.col(column)
    lo, hi, n = df.agg(F.min(v), F.max(v), F.count(v)).first()
    while lo < hi:
        inside = df.where(v.between(lo, hi))
        width = (hi - lo) / buckets
        if n <= small or width == 0 or lo + width == lo:
            ordered = inside.groupBy(v.alias("v")).count().orderBy("v").collect()
            for row in ordered:
                if rank < row["count"]:
                    return row["v"]
                rank -= row["count"]
        bucket = F.least(F.lit(buckets - 1), F.floor((v - F.lit(lo)) / F.lit(width)))
        rows = (inside.groupBy(bucket.alias("b")).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
                .orderBy("b").collect())
        for row in rows:
            if rank < row["n"]:
                lo, hi, n = row["lo"], row["hi"], row["n"]
                break
            rank -= row["n"]
    return lo


def scratch_root(spark: SparkSession) -> str:
    """The session's own folder under the shared folder named in ``spark.checkpoint.dir``.

    Without that setting a machine-local folder is made, but only on a local master: on a cluster every executor would
    write to its own disk, so a missing setting is an error there.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="letterwatch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/letterwatch-{context.applicationId}"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under the session's scratch folder."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete every copy this session has written; frames read from them are unusable afterwards."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the frame to the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dense_positions(df: DataFrame, order, name: str) -> DataFrame:
    """Add the zero-based position of each row in the given order (a column or a list of them), without a global window.

    Rows are range-partitioned and sorted, so that no value of a leading column has to fit one task as long as the order
    as a whole is nearly unique; the written copy fixes the partitions, and only their sizes are added up.
    """
    keys = [order] if isinstance(order, (str, Column)) else list(order)
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = materialize(df.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys).withColumns(
        {"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.select("_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))    # one row per partition
    return (placed.join(F.broadcast(earlier), F.col("_part") == F.col("_p"))
            .withColumn(name, F.col("_pos") + F.col("_before")).drop("_part", "_p", "_pos", "_before"))
