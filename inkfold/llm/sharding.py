"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over a prime number of slots: a start and a stride derived from its name. Shards take
turns, in order, to claim the next slot of their order that is still free, until the table is full; so shards hold equal
numbers of slots to within one, and when a shard is added or removed few slots change hands. The table has a fixed
number of rows whatever the data, so its broadcast is bounded, and a row is placed by one hash and one lookup, without
a shuffle. Placement is by key, so a source with a third of all rows is spread like any other.

A null key is placed by the row's digest column if one is given, else like an empty text. Very long keys are hashed whole.
Repeated keys go to one shard; shards have distinct names, so turns have no ties.
An empty table gives no rows. Extra columns are kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

#: Prime, and over a hundred slots for each shard.
SLOTS, SHARDS = 4099, 32


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's place in `shards` for each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and at most as many as slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [_number(f"start:{s}") % slots for s in shards]
    stride = [_number(f"stride:{s}") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + stride[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 15 hex digits of its md5, modulo the number of slots."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("bigint") % slots


def lookup(df: DataFrame, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as a DataFrame (slot, shard) of `slots` rows."""
    names = F.split(F.lit("\x1f".join(shards[k] for k in fill(shards, slots))), "\x1f")
    return df.sparkSession.range(1).select(F.posexplode(names).alias("slot", "shard"))


def assign(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, null_key: Column | None = None) -> DataFrame:
    """df with the columns slot and shard (replaced, if df has columns of these names)."""
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    text = F.coalesce(F.col(f"`{key}`").cast("string"), *([null_key.cast("string")] if null_key is not None else []), F.lit(""))
    placed = df.select(*kept, slot_of(text, slots).cast("int").alias("slot"))
    return placed.join(F.broadcast(lookup(df, shards, slots)), "slot").select(*[f"`{c}`" for c in placed.columns], "shard")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:04d}" for k in range(n)]


def oracle(table: str, key: str, n: int = SHARDS, slots: int = SLOTS) -> str:
    """DuckDB SQL for the same placement: the fill is a recursive query with one claim at a time."""
    number = "(('0x' || substr(md5({}), 1, 15))::BIGINT)"
    start, stride = number.format("'start:' || name"), number.format("'stride:' || name")
    return f"""
WITH RECURSIVE shards AS (
  SELECT k, name, {start} % {slots} AS start, {stride} % {slots - 1} + 1 AS stride
  FROM (SELECT k, format('shard-{{:04d}}', k) AS name FROM range({n}) t(k))
), lists AS (SELECT list(start ORDER BY k) AS starts, list(stride ORDER BY k) AS strides FROM shards),
filled AS (
  SELECT 0 AS claim, [-1 FOR x IN range({slots})] AS owner, -1::BIGINT AS slot FROM lists
  UNION ALL
  SELECT claim + 1, list_concat(list_concat(owner[1:pick], [claim % {n}]), owner[pick + 2:]), pick
  FROM (
    SELECT claim, owner, list_filter(
      [(starts[claim % {n} + 1] + j * strides[claim % {n} + 1]) % {slots} FOR j IN range({slots})],
      lambda s: owner[s + 1] = -1)[1] AS pick
    FROM filled, lists WHERE claim < {slots})
), slots AS (SELECT slot, (claim - 1) % {n} AS k FROM filled WHERE claim > 0)
SELECT d.doc_id, d.slot, s.name AS shard
FROM (SELECT {key} AS doc_id, CAST({number.format(f"coalesce(CAST({key} AS VARCHAR), '')")} % {slots} AS INTEGER) AS slot FROM {table}) d
JOIN slots USING (slot) JOIN shards s USING (k)
"""
