"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Every shard has a preference order over the slots of a table of prime size: (offset + j * skip)
mod size, from two digests of its name. Shards take turns; each claims the first slot of its
order that nobody has. A row's slot is a digest of its key modulo the size, and the slot's owner
is its shard. All shards own nearly the same number of slots, and when a shard leaves or comes,
few rows between the others move.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names

#: The table's size (a prime, at least a hundred times the shards), which bounds what is broadcast.
TABLE_SIZE = 2_039
#: Tables beyond this are refused: the table is broadcast, about sixteen bytes a slot.
MOST_SLOTS = 1 << 20
#: Hexadecimal digits of an MD5 digest that are read as a number.
DIGITS = 15


def number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The place in shards of each slot's owner."""
    if not shards or size < len(shards) or size > MOST_SLOTS or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("give at least one shard, and a prime size from the number of shards to MOST_SLOTS")
    offset = [number(f"{s}#offset") % size for s in shards]
    skip = [number(f"{s}#skip") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owner, turn = [-1] * size, [0] * len(shards)
    left = size
    while left:
        for k in range(len(shards)):
            while owner[slot := (offset[k] + turn[k] * skip[k]) % size] >= 0:
                turn[k] += 1
            owner[slot] = k
            left -= 1
            if not left:
                break
    return owner


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:03d}" for k in range(n)]


def assign(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """docs with ``slot`` and ``shard`` (a name in shards) added, replacing columns of these names; no row moves.

    A null key is a key like any other (its text is ``null``), and a key named ``slot`` or ``shard`` is
    read before it is replaced. Repeated rows share their shard. All rows and other columns are kept,
    whatever their names; an empty table gives none.
    """
    spark = docs.sparkSession
    here, at, owner, name = free_names(docs, "_here", "_slot", "_owner", "_shard")
    owners = json.dumps(lookup_table(shards, size))
    table = spark.range(1).select(F.posexplode(F.from_json(F.lit(owners), "array<int>")).alias(at, owner))
    names = F.from_json(F.lit(json.dumps(shards)), "array<string>")
    table = table.select(at, F.get(names, F.col(owner)).alias(name))
    digest = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")).cast("binary"))
    slot = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") % size).cast("int")
    placed = docs.withColumn(here, slot).drop("slot", "shard")
    return placed.join(F.broadcast(table), F.col(here) == F.col(at), "left").drop(at).withColumnsRenamed({here: "slot", name: "shard"})


def write_shards(docs: DataFrame, path: str, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE, files_per_shard: int = 4) -> None:
    """Writes docs as Parquet, one folder for each shard, each shard from files_per_shard tasks.

    Rows are dealt over a shard's files by a hash of the whole row (maps apart), so rows of one key that differ
    spread over the files. Rows that are alike share a file. An empty table writes no folder of a shard.
    """
    placed = assign(docs, shards, key, size)
    file, = free_names(placed, "_file")
    hashed = [F.col(f"`{f.name}`") for f in placed.schema.fields if "map<" not in f.dataType.simpleString()]
    placed = placed.withColumn(file, F.pmod(F.xxhash64(*hashed), F.lit(files_per_shard)))
    placed.repartition("shard", file).drop(file).write.partitionBy("shard").parquet(path)


def oracle_sql(shards: int, size: int = TABLE_SIZE) -> str:
    """DuckDB SQL that fills the table by turns in a recursive query and places documents in it."""
    return f"""
WITH RECURSIVE numbered AS (
  SELECT k, printf('shard-%03d', k) AS name FROM range({shards}) t(k)
), preferences AS (
  SELECT k, name,
    ('0x' || substr(md5(name || '#offset'), 1, {DIGITS}))::BIGINT % {size} AS first,
    ('0x' || substr(md5(name || '#skip'), 1, {DIGITS}))::BIGINT % {size - 1} + 1 AS skip
  FROM numbered
), orders AS (
  SELECT list(slots ORDER BY k) AS slots FROM (
    SELECT k, list_transform(range({size}), lambda j: (first + j * skip) % {size}) AS slots FROM preferences)
), turns AS (
  SELECT 0 AS step, CAST(NULL AS BIGINT) AS slot, list_transform(range({size}), lambda x: false) AS taken
  UNION ALL
  SELECT step + 1, chosen, list_concat(list_concat(taken[1:chosen], [true]), taken[chosen + 2:]) FROM (
    SELECT step, taken, list_filter(slots[step % {shards} + 1], lambda s: NOT taken[s + 1])[1] AS chosen FROM turns, orders WHERE step < {size})
), owners AS (
  SELECT slot, printf('shard-%03d', (step - 1) % {shards}) AS shard FROM turns WHERE step > 0
)
SELECT doc_id, CAST(p.slot AS INTEGER) AS slot, shard FROM (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, {DIGITS}))::BIGINT % {size} AS slot FROM documents
) p JOIN owners o ON o.slot = p.slot
"""
