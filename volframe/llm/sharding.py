"""Shards by jump consistent hashing, in Spark SQL alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import numbered, read

#: Fixed value: the multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757
_MASK = (1 << 32) - 1


def _low_half(x: str, by: int, plus: int = 0) -> str:
    """x * by + plus for x and by below 2^32, in two sums of at most 49 bits each, so that no long overflows: the lower
    one without what a carry of the upper half needs."""
    return f"({x} * {by & 0xFFFF} + shiftleft(({x} * {by >> 16}) & 65535, 16) + {plus})"


def _next_state() -> tuple[str, str]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2^64, where hi and lo are the halves of the state s."""
    low, high = MULTIPLIER & _MASK, MULTIPLIER >> 32
    sum_lo = _low_half("s.lo", low, 1)
    carry = f"shiftright({sum_lo}, 32) + shiftright(s.lo * {low >> 16}, 16)"
    return f"({carry} + {_low_half('s.hi', low)} + {_low_half('s.lo', high)}) & {_MASK}", f"{sum_lo} & {_MASK}"


def jump_hash(key: str, shards: int) -> Column:
    """Shard 0 to shards - 1 of column `key` (any type that can be hashed; null is a key like others).

    With one more shard a key stays where it is or moves to the new shard. The jumps are a fold over `shards` steps, the
    most that can be needed; a step does nothing once the next jump would leave the range.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    hi, lo = _next_state()
    h = f"xxhash64(`{key}`)"
    return F.expr(f"""aggregate(sequence(1, {shards}),
      named_struct('b', 0L, 'j', 0L, 'hi', shiftrightunsigned({h}, 32), 'lo', {h} & {_MASK}),
      (s, i) -> CASE WHEN s.j >= {shards} THEN s ELSE
        transform(array(named_struct('b', s.j, 'hi', {hi}, 'lo', {lo})), n -> named_struct(
          'b', n.b, 'j', CAST(floor((n.b + 1D) * (2147483648D / (shiftright(n.hi, 1) + 1D))) AS BIGINT), 'hi', n.hi, 'lo', n.lo))[0] END,
      s -> CAST(s.b AS INT))""")


def assign(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """rows with shard, slot (0, 1, ... within the shard) and grown_shard, the shard if there were one more.

    Key and number of shards alone decide the shard, so repeated keys and all null keys share one. Slots follow the
    order in which rows were written, and no shard's rows meet in one task to get them.
    """
    placed = rows.withColumns({"shard": jump_hash(key, shards), "grown_shard": jump_hash(key, shards + 1)})
    return numbered(placed, ["shard"], "shards")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return assign(rows, "doc_id", 16).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
