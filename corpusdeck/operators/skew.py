"""Joins that hold when one key carries a large share of the rows.

``HOT_SHARE`` bounds what is broadcast: a key is hot when it has more than ``1 / HOT_SHARE`` of
all fact rows, so there are at most ``HOT_SHARE`` hot keys whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 2_000
HOT_FLOOR = 100_000
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 32 << 20


def attach_by_key(
    facts: DataFrame, keyed: DataFrame, key: str, weight: str, salt: Column, floor: int = HOT_FLOOR
) -> DataFrame:
    """Inner join of ``facts`` with ``keyed``, one row per ``key`` (null is a key as well), where ``keyed[weight]``
    is the number of fact rows with that key (or a bound on it).

    Hot keys are spread over ``ceil(weight / limit)`` salts, so no task gets more than ``limit``
    rows of one key; all other keys keep a single salt and are joined as usual.
    """
    total = keyed.agg(F.sum(weight)).scalar()
    limit = F.greatest(total / F.lit(HOT_SHARE), F.lit(float(floor)))
    weighed = keyed.withColumn("_salts", F.ceil(F.col(weight) / limit).cast("int")).withColumnRenamed(key, "_key")
    hot = weighed.filter("_salts > 1").select("_key", F.col("_salts").alias("_fact_salts"))
    salted_facts = (
        facts.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_key")), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(salt), F.coalesce("_fact_salts", F.lit(1))).cast("int"))
        .drop("_fact_salts", "_key")
    )
    salted_keys = weighed.withColumn(
        "_key_salt", F.explode(F.sequence(F.lit(0), F.greatest("_salts", F.lit(1)) - 1))
    ).drop("_salts")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_key_salt"))
    return salted_facts.join(salted_keys, same).drop("_salt", "_key", "_key_salt")


def fits(table: DataFrame, max_rows: int = BROADCAST_ROWS, max_chars: int = BROADCAST_CHARS) -> bool:
    """Whether a table is small enough to broadcast; looks at ``max_rows + 1`` rows at most."""
    row_chars = F.length(F.to_json(F.struct(*[F.col(c) for c in table.columns])))
    counts = F.count("*").alias("rows"), F.coalesce(F.sum(row_chars), F.lit(0)).alias("chars")
    size = table.limit(max_rows + 1).agg(*counts).first()
    return size.rows <= max_rows and size.chars <= max_chars


def lookup(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    salt: Column,
    max_rows: int = BROADCAST_ROWS,
    max_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """Inner join with a lookup table that has one row per ``key``.

    The table is measured first, over at most ``max_rows + 1`` of its rows. Within the bounds it
    is broadcast and the facts do not move. Beyond them the keys are weighed by a map-side
    combined count and the join goes through :func:`attach_by_key`.
    """
    if fits(table, max_rows, max_chars):
        return facts.join(F.broadcast(table), key)
    weights = facts.groupBy(key).agg(F.count("*").alias("_weight"))
    return attach_by_key(facts, weights.join(table, key), key, "_weight", salt).drop("_weight")
