"""Packing token runs into sequences of a fixed length by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import giving_back, numbered, read, save
from .tokenizing import REST_WORDS, WordEncoder, groups, shared, texts_of, tokenizer_file

CAPACITY = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"


def fill(counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The reachable total closest to capacity, and how many runs of each length give it.

    Bounded subset sums on one bitset: bit s is set when s can be reached. A length with k runs is added in bundles of
    1, 2, 4, ... runs, the longest lengths first; the bitset before each bundle is kept, and walking back over them
    gives the counts. It ends early once the capacity itself is reached.
    """
    mask = (1 << (capacity + 1)) - 1
    reached, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, bundle = min(counts[length], capacity // length), 1
        while left:
            take = min(bundle, left)
            steps.append((length, take, reached))
            reached |= reached << (length * take) & mask
            left -= take
            bundle *= 2
            if reached >> capacity:
                break
        if reached >> capacity:
            break
    total = rest = reached.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> rest & 1:
            chosen[length] = chosen.get(length, 0) + take
            rest -= length * take
    return total, chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Patterns (runs of each length in one sequence, how many such sequences) that use up the histogram, and the number
    of sequences. Each window takes the longest run left and the multiset that fills the rest closest to capacity; the
    pattern is repeated as long as its lengths last. So the work depends on the number of lengths, at most `capacity`,
    and not on the number of runs.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    patterns, sequences = [], 0
    while left:
        longest = max(left)
        others = dict(left)
        others[longest] -= 1
        if not others[longest]:
            del others[longest]
        _, chosen = fill({k: v for k, v in others.items() if k <= capacity - longest}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        patterns.append((chosen, times))
        sequences += times
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return patterns, sequences


def _ranges(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first slot, slot after the last, first sequence, runs of this length in a sequence, offset of the first)."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for chosen, times in patterns:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n, at = chosen[length], used.get(length, 0)
            rows.append((length, at, at + n * times, first, n, offset))
            used[length] = at + n * times
            offset += n * length
        first += times
    return rows


def pack(runs: DataFrame, length: str, capacity: int = CAPACITY) -> DataFrame:
    """runs with sequence_id and offset, the place of each in sequences of at most `capacity` tokens.

    length: a column of 1 to capacity. Only the histogram of lengths, at most `capacity` rows, reaches the driver, which
    makes patterns from it. A run's number among those of its length then tells its sequence and offset. Runs of one
    length are numbered without meeting in one task. Within a sequence offsets have no gaps. An empty table gives none.
    Null or other lengths raise an error.
    """
    spark = runs.sparkSession
    sure = F.when(F.col(length).between(1, capacity), F.col(length).cast("long")).otherwise(F.raise_error(F.lit(f"{length} must be 1 to {capacity}")))
    slots = save(numbered(runs.withColumn(length, sure), [length], "runs", "_slot"), "slots")
    histogram = {r[0]: r[1] for r in slots.groupBy(length).count().collect()}  # at most `capacity` rows
    rows = _ranges(plan(histogram, capacity)[0])
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    size = np.int64(table[:, 2].max() + 1) if len(table) else np.int64(1)
    keys = table[:, 0] * size + table[:, 1]
    send = spark.sparkContext.broadcast((table, keys, size))  # a few ranges for each length
    kinds = slots.schema
    out = ", ".join(f"`{c}` {t}" for c, t in slots.dtypes if c != "_slot") + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, starts, wide = send.value
        for b in batches:
            lengths = b.column(b.schema.get_field_index(length)).to_numpy(zero_copy_only=False)
            slot = b.column(b.schema.get_field_index("_slot")).to_numpy(zero_copy_only=False)
            r = ranges[np.searchsorted(starts, lengths * wide + slot, side="right") - 1]
            k = slot - r[:, 1]
            keep = [i for i, name in enumerate(b.schema.names) if name != "_slot"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), pa.array(r[:, 3] + k // r[:, 4]), pa.array(r[:, 5] + k % r[:, 4] * lengths)],
                [*(b.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    assert "_slot" in kinds.names
    return slots.mapInArrow(giving_back(place), out)


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = shared(WordEncoder, path)
    try:
        for batch in batches:
            for first, texts in groups(texts_of(batch)):
                counts, ids = encoder.encode(texts)
                rows: list[tuple] = []
                at = 0
                for i, n in enumerate(counts):
                    own = np.append(ids[at : at + n], end_id).astype("<u4")
                    at += n
                    for start in range(0, len(own), capacity):
                        piece = own[start : start + capacity]
                        rows.append((first + i, start, len(piece), zlib.crc32(piece.tobytes()), len(own), piece if with_ids else None))
                where, *columns, pieces = zip(*rows, strict=True)
                arrays = [batch.column(0).take(pa.array(where)), *(pa.array(c, pa.int64()) for c in columns)]
                names = ["_key", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.array(pieces, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
    finally:
        encoder.store.rest(REST_WORDS)


def cut(docs: DataFrame, key: str, text: str, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens and, with_ids, ids of each piece of a document's ids and end_id.

    A document is cut after every `capacity` ids, so all of its pieces but the last fill a sequence. A null text counts
    as empty and gives the end id alone.
    """
    path = tokenizer or tokenizer_file(TOKENIZER)
    schema = f"_key {docs.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    return rows.mapInArrow(giving_back(lambda it: _cut(it, path, capacity, end_id, with_ids)), schema).withColumnRenamed("_key", key)


def pack_documents(docs: DataFrame) -> DataFrame:
    """All documents in sequences, a row for each piece: see cut() and pack()."""
    return pack(cut(docs, "doc_id", "text", with_ids=False), "length").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
