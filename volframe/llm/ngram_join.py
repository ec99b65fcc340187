"""Similarity join on word n-grams by vertical partitioning.

N-grams have one global order: rare ones first, in the order of their 64-bit hashes, then the commonest by how many
documents have them. Texts with equal sets of n-grams are one class and take part once, by the digest of their set.

1. Candidates. Two sets that are similar enough share an n-gram within a prefix of each, in the global order; of the
   smaller set a shorter prefix will do. The classes that have one n-gram in their prefixes, in the order of their sizes
   and cut where a size is too far from those before it, are buckets. Buckets of the same classes count once.
2. Filter. Every class has a parity bitmap of its n-grams. Where two bitmaps differ in more places than two similar
   sets can, the pair is dropped: a bound that loses nothing. Within buckets a folded, coarse bitmap does so first.
3. Overlaps. The order of the hashes is cut into fragments, and with it each set into segments. Segments of candidates
   meet by fragment, a row (pair, overlap) comes out of each, and rows are summed per pair.
4. Which pairs are counted. First each member of a bucket with two of its members, the hubs. What then hangs together is
   known to. Later rounds look only at pairs of a bucket that lie in different components and pass the filter: the
   first at a few for each class, the last at all, in the buckets that held any back. So the components are those of all
   links, while most pairs inside a large group of near copies are never looked at.
5. Links, if asked for. Within each component, pairs of similar size are counted in blocks, fragment by fragment, and
   only each set's number of links leaves a block. That work grows with the square of the different texts of one
   component, as its result does.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .shared import discard, giving_back, read, save, sized

#: Bytes of text that are hashed at a time, and that are made into sets at a time.
HASH_BYTES, RUN_BYTES = 1 << 19, 1_000_000
#: The commonest n-grams, which go last in the global order: those of this share of the documents of some task's stretch,
#: and at most so many. Either number changes only how many candidates there are, never the result.
COMMON_SHARE, COMMON_MOST = 0.001, 200_000
STRETCH_NGRAMS = 1_000_000
#: An n-gram of more documents than this makes a bucket that is never gathered, and whose pairs are dealt in tiles.
HOT_DOCS = 4096
#: Classes in a tile of a bucket, and how many pairs of a class in it each round before the last takes.
TILE_SETS, FIRST_PAIRS = 512, (4,)
#: Classes that a task remembers, so as to speak for each of them once.
SEEN_CLASSES = 1_000_000
#: Fragments of the global order, sets that meet one hub together, n-grams whose overlaps are counted at a time.
FRAGMENTS, HUB_SETS, COUNT_NGRAMS = 8, 256, 1_000_000
#: N-grams and sets in a block, and n-grams in a fragment when links are counted.
BLOCK_NGRAMS, BLOCK_SETS, FRAGMENT_NGRAMS = 1_500_000, 384, 4096
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


#: A word's hash is a polynomial over its bytes, modulo 2^64, with a random number for each byte; A-Z have those of a-z.
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE = np.random.default_rng(20).integers(1, 2**64 - 1, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]


@lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words on end, words of each text) of texts whose bytes lie between the offsets."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)  # where no word goes on from the byte before
    cut[offsets] = True
    cut[1:-1] |= ~inside[:-1]
    starts = np.flatnonzero(inside & cut[:-1])
    cut[:-1] |= ~inside
    ends = np.flatnonzero(inside & cut[1:]) + 1
    h = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + HASH_BYTES, side="right")))
        size = int(ends[to - 1] - first)
        powers, inverse = _tables(HASH_BYTES if size <= HASH_BYTES else 1 << size.bit_length())
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[data[first : first + size]] * powers[:size], out=total[1:])
        h[at:to] = (total[ends[at:to] - first] - total[starts[at:to] - first]) * inverse[starts[at:to] - first]
        at = to
    h = _mix(h + (ends - starts).astype(np.uint64) * U(0x632BE59BD9B4E019))
    return h, np.bincount(np.searchsorted(offsets, starts, side="right") - 1, minlength=len(offsets) - 1)


def _runs_of(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(index of the first, texts) for runs of about RUN_BYTES; null is the empty text. A longer text stands alone."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.cumsum(np.asarray(pc.binary_length(texts)))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_BYTES, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def ngram_sets(texts: pa.Array | list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, the sets' n-grams on end, each set ascending).

    A-Z are lower-cased; words are what ASCII white space separates. Of a text with 1 to k - 1 words the whole sequence
    is the only n-gram; a text without words has the empty set.
    """
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    h, counts = _word_hashes(data, offsets - offsets[0])
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(h)
    grams = h.copy()
    for j in range(1, min(k, n)):
        grams[: n - j] = grams[: n - j] * U(0x9E3779B97F4A7C15) + h[j:]
    whole = np.zeros(n, bool)
    if n >= k:
        whole[: n - k + 1] = doc[: n - k + 1] == doc[k - 1 :]
    grams, owner = _mix(grams[whole]), doc[whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        ends = np.cumsum(counts)
        few = [xxhash.xxh64_intdigest(h[ends[i] - counts[i] : ends[i]].tobytes(), seed=int(counts[i])) for i in short]
        grams, owner = np.concatenate([grams, np.array(few, np.uint64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    for begin, end in itertools.pairwise(np.searchsorted(owner, np.arange(len(counts) + 1)).tolist()):
        grams[begin:end].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[new], minlength=len(counts)), grams[new]


def _run_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class Sets(NamedTuple):
    """How texts become sets of n-grams and sets classes, alike in all tasks. A class is told by a number of 64 bits or, where
    sets that differ share that (`doubled`, ascending), by another of 64. bits: fewer of the first, to test what then happens."""

    k: int
    bits: int = 64
    doubled: np.ndarray = np.zeros(0, np.uint64)

    def both(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, the sets' n-grams on end, first and second number of each set): together the same for equal sets alone, but
        for collisions of 128 bits."""
        sizes, grams = ngram_sets(texts, self.k)
        one = _run_sums(_mix(grams ^ U(0x5851F42D4C957F2D)), sizes)
        two = _run_sums(_mix(grams ^ U(0x14057B7EF767814F)), sizes)
        return sizes, grams, _mix(one + _mix(two + sizes.astype(np.uint64))) >> U(64 - self.bits), _mix(two)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, n-grams on end, class of each set)."""
        sizes, grams, c, other = self.both(texts)
        return sizes, grams, np.where(np.isin(c, self.doubled), other, c).view(np.int64)


def told_apart(sets: DataFrame, ways: Sets) -> tuple[DataFrame, DataFrame, Sets]:
    """(sets, with the class as c; the classes (c, n, th, class_id, m), saved; ways that give the same classes) of rows that have
    Sets.both's numbers as c and d. Of N sets some N * N / 2^65 share the first: 300 of 10^11, so these are collected."""
    own = F.min("n").alias("n"), F.min("th").alias("th"), F.min("doc_id").alias("class_id"), F.count("*").alias("m")
    classes = save(sets.where("n > 0").groupBy("c").agg(*own, F.min("d").alias("low"), F.max("d").alias("high")), "classes")
    doubled = classes.where("low < high").select("c")
    values = np.sort(np.array([r["c"] for r in doubled.collect()], np.int64).view(np.uint64))
    if len(values):
        two = doubled.withColumn("_two", F.lit(True))
        sets = sets.join(F.broadcast(two), "c", "left").withColumn("c", F.when(F.col("_two"), F.col("d")).otherwise(F.col("c"))).drop("_two")
        classes = save(sets.where("n > 0").groupBy("c").agg(*own), "classes")
    return sets, classes.select("c", "n", "th", "class_id", "m"), ways._replace(doubled=values)


class _Once:
    """Tells what a task has not seen before; forgets all when it holds too much."""

    def __init__(self):
        self.seen: set[int] = set()

    def new(self, values: np.ndarray) -> np.ndarray:
        first = np.zeros(len(values), bool)
        first[np.unique(values, return_index=True)[1]] = True
        if len(self.seen) > SEEN_CLASSES:
            self.seen.clear()
        if self.seen:
            first &= np.fromiter((v not in self.seen for v in values.tolist()), bool, len(values))
        self.seen.update(values[first].tolist())
        return first


SETS = "doc_id long, th long, n long, c long, d long"


def _describe(batches: Iterator[pa.RecordBatch], ways: Sets) -> Iterator[pa.RecordBatch]:
    """A row for each document; then, with a null doc_id and n = -1, n-grams (th) that are common in a stretch of the
    rows, with the number of documents (c) that have them."""
    names = ["doc_id", "th", "n", "c", "d"]
    held: list[np.ndarray] = []
    n_docs = size = 0

    def common() -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = times >= max(8, COMMON_SHARE * n_docs)
        m = int(often.sum())
        return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(values[often].view(np.int64)), pa.array(np.full(m, -1)), pa.array(times[often].astype(np.int64)), pa.nulls(m, pa.int64())], names)

    for b in batches:
        for at, run in _runs_of(_texts(b)):
            sizes, grams, *numbers = ways.both(run)
            c, d = (pa.array(x.view(np.int64), mask=sizes == 0) for x in numbers)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(run)), b.column(2).slice(at, len(run)), pa.array(sizes.astype(np.int64)), c, d], names)
            held.append(grams)
            n_docs += len(run)
            size += len(grams)
            if size >= STRETCH_NGRAMS:
                yield common()
                held, n_docs, size = [], 0, 0
    yield common()


def prefixes(sizes: np.ndarray, grams: np.ndarray, threshold: int, common: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths of the sets' prefixes in the global order; how much of each is its shorter prefix; how much is not hot;
    the prefixes' n-grams on end). common: the commonest n-grams, ascending, and in how many documents they are.

    Two sets of n <= m n-grams whose overlap o reaches the threshold t have o >= 2 t n / (100 + t) and o >= t m / 100, so
    the first n - ceil(2 t n / (100 + t)) + 1 of the one and the first m - ceil(t m / 100) + 1 of the other share one.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    weight = np.zeros(len(grams), np.int64)
    if len(common) and len(grams):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        weight = np.where(common[at] == grams, times[at], 0)
        order = np.lexsort((weight, owner))  # n-grams stay ascending among those of one weight
        grams, weight = grams[order], weight[order]
    some = sizes > 0
    longer = np.where(some, sizes + (-threshold * sizes) // 100 + 1, 0)
    shorter = np.where(some, sizes + (-2 * threshold * sizes) // (100 + threshold) + 1, 0)
    place = np.arange(len(grams)) - (np.cumsum(sizes) - sizes)[owner]
    taken = place < longer[owner]
    calm = np.bincount(owner[taken & (weight <= HOT_DOCS)], minlength=len(sizes))
    return longer, shorter, calm, grams[taken]


def _bit_bytes(sizes: np.ndarray) -> np.ndarray:
    """Bytes of a set's bitmap: at least two bits for each n-gram, a power of two, from 16 to 8192."""
    return 2 ** np.clip(np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) - 2, 4, 13)


def _coarse_bytes(sizes: np.ndarray, threshold: int) -> np.ndarray:
    """Bytes of a set's coarse bitmap, no more than those of the other: so many that two unlike sets of this size, which
    differ in about half of the bits, differ in at least twice as many as two similar ones can."""
    bits = np.maximum(8 * (100 - threshold) / (100 + threshold) * sizes, 1)
    return np.minimum(2 ** np.clip(np.ceil(np.log2(bits)).astype(np.int64) - 3, 4, 13), _bit_bytes(sizes))


def bitmaps(sizes: np.ndarray, grams: np.ndarray, coarse: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each set's bitmap, the bitmaps on end). A bit is the parity of the n-grams that fall on it. coarse: the
    threshold that coarse bitmaps, which are foldings of the others, are for."""
    size = _bit_bytes(sizes) if coarse is None else _coarse_bytes(sizes, coarse)
    begins = np.cumsum(size) - size
    bit = np.repeat(begins, sizes) * 8 + (grams & np.repeat(size * 8 - 1, sizes).astype(np.uint64)).astype(np.int64)
    return size, np.packbits((np.bincount(bit, minlength=int(size.sum()) * 8) & 1).astype(np.uint8))


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps, one a row, as they would be with fewer bytes."""
    while bits.shape[1] > size:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def possible(n: np.ndarray, bits: list[bytes], i: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
    """An upper bound of the overlap of sets i with sets j, and -1 where that is too small for the threshold."""
    size = np.array([len(x) for x in bits], np.int64)
    least, most = np.minimum(size[i], size[j]), np.full(len(i), -1, np.int64)
    for own in np.unique(least):
        pairs = np.flatnonzero(least == own)
        used = np.unique(np.concatenate([i[pairs], j[pairs]]))
        rows = np.zeros((len(used), int(own)), np.uint8)
        for wide in np.unique(size[used]):
            some = np.flatnonzero(size[used] == wide)
            rows[some] = _folded(np.frombuffer(b"".join(bits[x] for x in used[some]), np.uint8).reshape(len(some), -1), int(own))
        rows = rows.view(np.uint64)
        step = max(1, 4_000_000 // int(own))
        for at in range(0, len(pairs), step):
            p = pairs[at : at + step]
            differ = np.bitwise_count(rows[np.searchsorted(used, i[p])] ^ rows[np.searchsorted(used, j[p])]).sum(1, dtype=np.int64)
            both = n[i[p]] + n[j[p]]
            most[p] = np.where((both - differ) * (100 + threshold) >= 2 * threshold * both, (both - differ) // 2, -1)
    return most


def _binary(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


PREFIXES = "c long, n long, bits binary, coarse binary, short int, calm int, tokens array<long>"


def _prefix_rows(batches: Iterator[pa.RecordBatch], ways: Sets, threshold: int, common: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    once = _Once()
    for b in batches:
        for _, run in _runs_of(_texts(b)):
            sizes, grams, c = ways.of(run)
            new = once.new(c) & (sizes > 0)
            grams, sizes, c = grams[np.repeat(new, sizes)], sizes[new], c[new]
            longer, shorter, calm, tokens = prefixes(sizes, grams, threshold, common, times)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(longer)]).astype(np.int32), pa.array(tokens.view(np.int64)))
            maps = _binary(*bitmaps(sizes, grams)), _binary(*bitmaps(sizes, grams, threshold))
            columns = [pa.array(c), pa.array(sizes.astype(np.int64)), *maps, pa.array(shorter.astype(np.int32)), pa.array(calm.astype(np.int32)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["c", "n", "bits", "coarse", "short", "calm", "tokens"])


def _texts(b: pa.RecordBatch) -> pa.Array:
    return b.column(b.schema.get_field_index("text"))


def _column(b: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    c = b.column(b.schema.get_field_index(name))
    return c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy()


def size_runs(token: np.ndarray, n: np.ndarray, short: np.ndarray, threshold: int) -> np.ndarray:
    """Where a new run begins in rows sorted by token, size, and first those with the token in their shorter prefixes.

    Of two rows of a token that can be similar, the one that comes first has it in its shorter prefix, and its size is
    near enough to the other's. So a row that the nearest such row before it is too small for meets none before it, and
    nor do those after it.
    """
    at = np.arange(len(token))
    before = np.full(len(token), -1)
    before[1:] = np.maximum.accumulate(np.where(short, at, -1))[:-1]
    near = np.maximum(before, 0)
    return (before < 0) | (token[near] != token) | (100 * n[near] < threshold * n)


def _meet(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, c, ns), ns being twice the size, plus one in the shorter prefix, come sorted by token. Out come
    (bucket, c, ns): the classes of each token in runs of sizes near each other, each run of several under one number."""
    once = _Once()

    def found(token: np.ndarray, c: np.ndarray, ns: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((c, 1 - (ns & 1), ns >> 1, token))
        token, c, ns = token[order], c[order], ns[order]
        other = np.ones(len(token), bool)
        other[1:] = (token[1:] != token[:-1]) | (c[1:] != c[:-1])
        token, c, ns = token[other], c[other], ns[other]
        starts = np.flatnonzero(size_runs(token, ns >> 1, (ns & 1).astype(bool), threshold))
        size = np.diff(np.append(starts, len(token)))
        total = np.add.reduceat(_mix(_mix(c.view(np.uint64)) + (ns & 1).astype(np.uint64)), starts)
        bucket = _mix(total + size.astype(np.uint64)).view(np.int64)
        kept = np.flatnonzero(size > 1)
        kept = kept[once.new(bucket[kept])]
        rows = np.isin(np.repeat(np.arange(len(size)), size), kept)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(bucket, size)[rows]), pa.array(c[rows]), pa.array(ns[rows])], ["bucket", "c", "ns"])

    held: list[tuple] = []
    for b in batches:
        columns = [_column(b, x) for x in ("token", "c", "ns")]
        if not b.num_rows:
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut == 0 and held and held[-1][0][-1] != columns[0][0]:
            yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        if cut:
            yield found(*(np.concatenate(x) for x in zip(*held, [x[:cut] for x in columns], strict=True)))
            held = []
        held.append(tuple(x[cut:] for x in columns))
    if held:
        yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _may_link(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, na, bits_a, nb, bits_b) the pairs (a, b, na, nb) that may be similar enough."""
    for b in batches:
        m = b.num_rows
        n = np.concatenate([_column(b, "na"), _column(b, "nb")])
        bits = [*b.column(b.schema.get_field_index("bits_a")).to_pylist(), *b.column(b.schema.get_field_index("bits_b")).to_pylist()]
        yield b.select(["a", "b", "na", "nb"]).filter(pa.array(possible(n, bits, np.arange(m), np.arange(m) + m, threshold) >= 0))


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of equal keys, as tables; rows come sorted by them."""
    held, at = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [_column(b, x) for x in keys]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        for begin, end in itertools.pairwise([0, *np.flatnonzero(new).tolist(), b.num_rows]):
            own = tuple(int(c[begin]) for c in columns)
            if held and own != at:
                yield pa.Table.from_batches(held)
                held = []
            at = own
            held.append(b.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


TILE = ("bucket", "i", "j")


def _across(batches: Iterator[pa.RecordBatch], threshold: int, most: int) -> Iterator[pa.RecordBatch]:
    """(bucket, a, b, held_back) of the pairs of a tile that lie in different components and may be similar enough: at most
    `most` of each class with those before it, the ones with the highest bounds, and whether there were more. Where rows
    say in `mine` which buckets their class is in, only the first bucket that a pair has in common speaks for it."""
    for rows in _runs(batches, TILE):
        c, ns, part, side = (_column(rows, x) for x in ("c", "ns", "part", "side"))
        n, short = ns >> 1, (ns & 1).astype(bool)
        same = rows["i"][0].as_py() == rows["j"][0].as_py()
        left = np.arange(len(c)) if same else np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        x, y = n[left][:, None], n[right][None, :]
        ok = (part[left][:, None] != part[right][None, :]) & (100 * np.minimum(x, y) >= threshold * np.maximum(x, y))
        ok &= ((x <= y) & short[left][:, None]) | ((y <= x) & short[right][None, :])
        i, j = np.nonzero(np.triu(ok) if same else ok)
        if not len(i):
            continue
        i, j = left[i], right[j]
        bound = possible(n, rows["coarse"].to_pylist(), i, j, threshold)
        i, j, bound = i[bound >= 0], j[bound >= 0], bound[bound >= 0]
        if "mine" in rows.column_names and len(i):
            mine, here = rows["mine"].to_pylist(), rows["bucket"][0].as_py()
            sets = {x: set(mine[x]) for x in np.union1d(i, j).tolist()}
            first = np.array([min(sets[x] & sets[y]) == here for x, y in zip(i.tolist(), j.tolist(), strict=True)])
            i, j, bound = i[first], j[first], bound[first]
        if not len(i):
            continue
        order = np.lexsort((-bound / (n[i] + n[j]), j))
        i, j = i[order], j[order]
        first = np.ones(len(i), bool)
        first[1:] = j[1:] != j[:-1]
        starts = np.flatnonzero(first)
        rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
        more = np.repeat(np.diff(np.append(starts, len(i))) > most, np.diff(np.append(starts, len(i))))
        some = rank < most
        i, j, more = i[some], j[some], more[some]
        i, j = np.where(c[i] < c[j], i, j), np.where(c[i] < c[j], j, i)
        bucket = np.full(len(i), rows["bucket"][0].as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, c[i], c[j], more)], ["bucket", "a", "b", "held_back"])


def _segments(batches: Iterator[pa.RecordBatch], ways: Sets) -> Iterator[pa.RecordBatch]:
    """(c, fragment, grams): the sets cut by the fragments of the hashes' order; empty segments are left out."""
    once = _Once()
    for b in batches:
        for _, run in _runs_of(_texts(b)):
            sizes, grams, c = ways.of(run)
            new = once.new(c)
            grams, sizes, c = grams[np.repeat(new, sizes)], sizes[new], c[new]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            piece = owner * FRAGMENTS + ((grams >> U(32)) * U(FRAGMENTS) >> U(32)).astype(np.int64)
            number, size = np.unique(piece, return_counts=True)
            columns = [pa.array(c[number // FRAGMENTS]), pa.array((number % FRAGMENTS).astype(np.int32)), _binary(size * 8, grams)]
            yield pa.RecordBatch.from_arrays(columns, ["sc", "fragment", "grams"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, overlap) within one fragment. Rows (a, chunk, fragment, side, c, grams) come sorted by the first three, so
    a hub's segment (side 0) and its members' (side 1) stand together; many hubs are counted in one go."""

    def counted(held: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(held).combine_chunks()
        a, chunk, fragment, side, c = (_column(rows, x) for x in ("a", "chunk", "fragment", "side", "c"))
        size = np.asarray(pc.binary_length(rows["grams"])) // 8
        values = np.frombuffer(b"".join(rows["grams"].to_pylist()), np.uint64)
        group = _mix(_mix(a.view(np.uint64)) + (chunk * FRAGMENTS + fragment).astype(np.uint64))
        keys = _mix(values + np.repeat(group, size))
        row = np.repeat(np.arange(len(a)), size)
        hub = (side == 0)[row]
        hubs = np.unique(keys[hub])
        keys, row = keys[~hub], row[~hub]
        if not len(hubs) or not len(keys):
            hit = np.zeros(len(keys), bool)
        else:
            hit = hubs[np.minimum(np.searchsorted(hubs, keys), len(hubs) - 1)] == keys
        n = np.bincount(row[hit], minlength=len(a))
        some = n > 0
        # a class that several tasks spoke for has its segment here more than once
        order = np.flatnonzero(some)
        _, first = np.unique(_mix(group[order] + _mix(c[order].view(np.uint64))), return_index=True)
        order = order[first]
        return pa.RecordBatch.from_arrays([pa.array(a[order]), pa.array(c[order]), pa.array(n[order])], ["a", "b", "overlap"])

    held, size = [], 0
    for rows in _runs(batches, ("a", "chunk", "fragment")):
        held.append(rows)
        size += rows.nbytes // 8
        if size >= COUNT_NGRAMS:
            yield counted(held)
            held, size = [], 0
    if held:
        yield counted(held)


def _tokens(batches: Iterator[pa.RecordBatch], ways: Sets) -> Iterator[pa.RecordBatch]:
    once = _Once()
    for b in batches:
        for _, run in _runs_of(_texts(b)):
            sizes, grams, c = ways.of(run)
            new = once.new(c)
            yield pa.RecordBatch.from_arrays([pa.array(c[new]), _binary(sizes[new] * 8, grams[np.repeat(new, sizes)])], ["_doc", "grams"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets: partial counts of one fragment after another, summed."""
    total = np.zeros((len(left), len(right)), np.float32)
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    number = np.cumsum(first) - 1
    shared = (np.bincount(number) > 1)[number]
    owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
    for begin in range(0, int(number.max(initial=-1)) + 1, FRAGMENT_NGRAMS):
        a, z = np.searchsorted(number, [begin, begin + FRAGMENT_NGRAMS])
        has = np.zeros((len(left) + len(right), min(FRAGMENT_NGRAMS, int(number[z - 1]) - begin + 1)), np.float32)
        has[owner[a:z], number[a:z] - begin] = 1
        total += has[: len(left)] @ has[len(left) :].T
    return total.astype(np.int64)


def _linked(rows: list[dict], threshold: int) -> list[tuple[int, int]]:
    """(set, links) of a block pair's sets that have links. Links count documents: a set counts as often as documents
    have it. A block may be empty, and has no links then."""
    sides: list[dict] = [{r["doc"]: r for r in rows if r["side"] == s} for s in (0, 1)]
    same = bool(rows) and rows[0]["band_a"] == rows[0]["band_b"] and rows[0]["block_a"] == rows[0]["block_b"]
    a, b = list(sides[0].values()), list(sides[0 if same else 1].values())
    if not a or not b:
        return []
    sets = [[np.frombuffer(r["grams"], np.uint64) for r in side] for side in (a, b)]
    o = overlaps(*sets)
    sizes = [np.array([len(x) for x in s]) for s in sets]
    link = (o > 0) & (100 * o >= threshold * (sizes[0][:, None] + sizes[1][None, :] - o))
    if same:
        np.fill_diagonal(link, False)
    weights = [np.array([r["m"] for r in side]) for side in (a, b)]
    counts = [(a, link @ weights[1])] if same else [(a, link @ weights[1]), (b, weights[0] @ link)]
    return [(r["doc"], int(n)) for side, found in counts for r, n in zip(side, found, strict=True) if n]


BLOCK_PAIR = ("cluster", "band_a", "band_b", "block_a", "block_b")


def _count(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block pair; one block pair is held at a time."""
    for rows in _runs(batches, BLOCK_PAIR):
        if out := _linked(rows.to_pylist(), threshold):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["c", "links"])


def _tiles(members: DataFrame, threshold: int) -> DataFrame:
    """A row for each of the block pairs that a set of a cluster takes part in: (BLOCK_PAIR, side, doc, m).

    Bands of sizes are so wide that similar sets are in one band or in neighbouring ones. A band has as many blocks as
    its sets need, and a set falls in one by hash.
    """
    width = math.log(100 / threshold) * 1.0001 + 1e-9 if threshold < 100 else 1.0
    banded = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width).cast("long"))
    per_block = F.greatest(F.lit(4.0), F.least(F.lit(float(BLOCK_SETS)), F.lit(float(BLOCK_NGRAMS)) / F.avg("n")))
    w = Window.partitionBy("cluster").orderBy("band")  # a row for each band of a cluster
    near = lambda by: F.when((F.lag if by < 0 else F.lead)("band").over(w) == F.col("band") + by, (F.lag if by < 0 else F.lead)("blocks").over(w)).otherwise(0)
    bands = banded.groupBy("cluster", "band").agg(F.ceil(F.count("*") / per_block).cast("int").alias("blocks")).withColumns({"below": near(-1), "above": near(1)})
    at = banded.join(bands, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    part = "named_struct('band_a', band{a}, 'band_b', band{b}, 'block_a', {i}, 'block_b', {j}, 'side', {s})"
    each = lambda n, **x: f"transform(IF({n} > 0, sequence(0, {n} - 1), CAST(array() AS array<int>)), j -> {part.format(**x)})"
    own = each("blocks", a="", b="", i="least(block, j)", j="greatest(block, j)", s="CAST(block > j AS INT)")
    up = each("above", a="", b=" + 1", i="block", j="j", s="0")
    down = each("below", a=" - 1", b="", i="j", j="block", s="1")
    return at.select("cluster", "doc", "m", F.explode(F.expr(f"concat({own}, {up}, {down})")).alias("t")).select("cluster", "t.band_a", "t.band_b", "t.block_a", "t.block_b", "t.side", "doc", "m")


class _Join:
    """One run of the join: its tables in the shared folder and the steps on them."""

    def __init__(self, docs: DataFrame, key: str, text: str, ways: Sets, threshold: int):
        self.threshold = threshold
        self.rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
        described = save(self.rows.mapInArrow(giving_back(lambda it: _describe(it, ways)), SETS), "sets")
        often = described.where("doc_id IS NULL AND n = -1").groupBy("th").agg(F.sum("c").alias("times")).orderBy(F.desc("times"), "th").limit(COMMON_MOST)
        most = sorted((r["th"] % 2**64, r["times"]) for r in often.collect())  # at most COMMON_MOST
        self.common = np.array([x for x, _ in most], np.uint64), np.array([x for _, x in most], np.int64)
        self.sets, self.classes, self.ways = told_apart(described.where("n >= 0"), ways)

    def texts(self, classes: DataFrame) -> DataFrame:
        """The rows whose text stands for one of these classes (c): few by broadcast, else each text moves once."""
        return self.rows.join(sized(self.classes.join(classes, "c", "left_semi").select("th")), "th", "left_semi").select("doc_id", "text", "th")

    def buckets(self) -> tuple[DataFrame, DataFrame]:
        """(bucket, c, ns): classes with an n-gram in their prefixes in common; and (c, n, bits, coarse) of these classes."""
        spark, ways, threshold = self.rows.sparkSession, self.ways, self.threshold
        common = spark.sparkContext.broadcast(self.common)
        rows = save(self.rows.mapInArrow(giving_back(lambda it: _prefix_rows(it, ways, threshold, *common.value)), PREFIXES), "prefixes")
        each = rows.select("c", "n", F.expr("inline(transform(tokens, (t, i) -> struct(t AS token, i < short AS short, i >= calm AS hot)))"))
        each = each.select("token", "c", (F.col("n") * 2 + F.col("short").cast("long")).alias("ns"), "hot")
        calm = each.where("NOT hot").drop("hot").repartition("token").sortWithinPartitions("token").mapInArrow(giving_back(lambda it: _meet(it, threshold)), "bucket long, c long, ns long")
        hot = each.where("hot").select(F.col("token").alias("bucket"), "c", "ns")
        found = save(calm.unionByName(hot).distinct(), "buckets")
        bits = save(rows.join(found.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("coarse").alias("coarse")), "bitmaps")
        discard(rows)
        return found, bits

    def hub_pairs(self, buckets: DataFrame, hubs: DataFrame, bits: DataFrame) -> DataFrame:
        """(a, b, na, nb), saved: each bucket's hubs a with its other classes b, where the filter lets them through."""
        near = f"100 * least(n, na) >= {self.threshold} * greatest(n, na) AND (n <= na AND ns % 2 = 1 OR na <= n AND hub.ns % 2 = 1)"
        met = buckets.join(hubs, "bucket").select("c", "ns", F.explode(F.expr("CASE c WHEN low.c THEN array() WHEN high.c THEN array(low) ELSE array(low, high) END")).alias("hub"))
        pairs = met.withColumns({"n": F.expr("ns DIV 2"), "na": F.expr("hub.ns DIV 2")}).where(near).select(F.col("hub.c").alias("a"), F.col("c").alias("b")).distinct()
        near = save(self.filtered(pairs, bits, "coarse").select("a", "b"), "coarse_pairs")
        kept = save(self.filtered(near, bits), "pairs")
        discard(near)
        return kept

    def filtered(self, pairs: DataFrame, bits: DataFrame, bitmap: str = "bits") -> DataFrame:
        """(a, b, na, nb) of the pairs (a, b) that their bitmaps let through; na and nb are sizes. only the
        full bitmaps that pairs take are moved; then pairs is a saved table, as it is read more than once."""
        threshold = self.threshold
        if bitmap == "bits":
            bits = bits.join(sized(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()), "c", "left_semi")
        of = lambda x: bits.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col(bitmap).alias(f"bits_{x}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(giving_back(lambda it: _may_link(it, threshold)), "a long, b long, na long, nb long")

    def across(self, rows: DataFrame, bits: DataFrame, most: int) -> DataFrame:
        """(bucket, a, b, held_back) over rows (bucket, c, ns, part): pairs in different parts that the coarse filter lets through.

        A bucket of more than TILE_SETS classes is dealt in tiles: its most frequent part against all others, and those
        among themselves. Pairs within the most frequent part, however large, meet nowhere.
        """
        threshold = self.threshold
        per = rows.groupBy("bucket", "part").agg(F.count("*").alias("m"))
        mixed = per.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.max("m").alias("most"), F.max_by("part", F.struct("m", "part")).alias("main")).where("parts > 1")
        blocks = lambda n: F.ceil(n / TILE_SETS).cast("int")
        at = rows.join(mixed, "bucket").withColumns({"others": blocks(F.col("m") - F.col("most")), "mains": blocks(F.col("most")), "h": F.xxhash64("c")})
        own = "CAST(pmod(h, {}) AS INT)".format
        tile = "struct({} AS i, {} AS j, {} AS side)".format
        tiles = f"""CASE WHEN m <= {TILE_SETS} THEN array({tile("0", "0", "0")})
            WHEN part = main THEN transform(sequence(0, others - 1), x -> {tile("x", f"others + {own('mains')}", "1")})
            ELSE concat(transform(sequence(0, others - 1), x -> {tile(f"least(x, {own('others')})", f"greatest(x, {own('others')})", f"IF({own('others')} > x, 1, 0)")}),
                transform(sequence(0, mains - 1), x -> {tile(own("others"), "others + x", "0")})) END"""
        carried = [x for x in ("coarse", "mine") if x in bits.columns]
        dealt = at.select("bucket", "c", "ns", "part", F.expr(f"inline({tiles})")).join(bits.select("c", *carried), "c")
        return dealt.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(giving_back(lambda it: _across(it, threshold, most)), "bucket long, a long, b long, held_back boolean")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, na, nb), na and nb being sizes, those (a, b) that are similar enough, saved. Each set's segments meet its hubs' by fragment."""
        ways = self.ways
        ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        segments = self.texts(ends).mapInArrow(giving_back(lambda it: _segments(it, ways)), "sc long, fragment int, grams binary")
        chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_SETS).alias("chunks"))
        dealt = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"))
        sides = dealt.select("a", "chunk", F.lit(1).alias("side"), F.col("b").alias("c")).unionByName(dealt.select("a", "chunk", F.lit(0).alias("side"), F.col("a").alias("c")).distinct())
        met = sides.join(segments, F.col("c") == F.col("sc")).select("a", "chunk", "fragment", "side", "c", "grams")
        by = ("a", "chunk", "fragment")
        counted = met.repartition(*by).sortWithinPartitions(*by).mapInArrow(giving_back(_partial), "a long, b long, overlap long")
        total = counted.groupBy("a", "b").agg(F.sum("overlap").alias("o")).join(pairs, ["a", "b"])
        return save(total.where(f"100 * o >= {self.threshold} * (na + nb - o)").select("a", "b"), "linked")

    def components(self) -> DataFrame:
        """(c, part) of every class that links with another; part is the smallest class that links reach."""
        buckets, bits = self.buckets()
        hubs = save(buckets.groupBy("bucket").agg(F.min(F.struct("c", "ns")).alias("low"), F.max(F.struct("c", "ns")).alias("high"), F.count("*").alias("m")), "hubs")
        pairs = self.hub_pairs(buckets, hubs.drop("m"), bits)
        links = self.verified(pairs)
        rest = save(buckets.join(hubs.where("m > 3").drop("m"), "bucket").where("c <> low.c AND c <> high.c").select("bucket", "c", "ns"), "rest")
        hung = lambda edges: connected_components(edges, "a", "b").select(F.col("node").alias("c"), F.col("component").alias("part"))
        parts = hung(links)
        left, over = rest, [pairs, links]
        for most in (*FIRST_PAIRS, 2**62):
            now = save(left.join(parts, "c", "left").withColumn("part", F.coalesce("part", "c")), "placed")
            found = save(self.across(now, bits, most), "across")
            for table in over:
                discard(table)
            over = [now, found]
            if found.isEmpty():
                break
            near = save(found.select("a", "b").distinct(), "coarse_pairs")
            met = save(self.filtered(near, bits), "pairs")
            new = self.verified(met)
            over += [near, met, new]
            if not new.isEmpty():  # known components go on as stars
                parts = save(hung(new.unionByName(parts.select(F.col("part").alias("a"), F.col("c").alias("b")))), "parts")
            back = found.where("held_back").select("bucket").distinct()
            if back.isEmpty():
                break
            left = rest.join(back, "bucket", "left_semi")
        for table in (buckets, bits, hubs, rest, *over):
            discard(table)
        return parts

    def n_links(self, parts: DataFrame) -> DataFrame:
        """(c, links) of every class that links with another."""
        ways, threshold = self.ways, self.threshold
        members = save(parts.join(self.classes, "c").select(F.col("part").alias("cluster"), F.col("c").alias("doc"), "n", "m"), "members")
        sets = self.texts(members.select(F.col("doc").alias("c"))).mapInArrow(giving_back(lambda it: _tokens(it, ways)), "_doc long, grams binary")
        dealt = _tiles(members, threshold).join(sets, F.col("doc") == F.col("_doc")).drop("_doc")
        return dealt.repartition(*BLOCK_PAIR).sortWithinPartitions(*BLOCK_PAIR).mapInArrow(giving_back(lambda it: _count(it, threshold)), "c long, links long").groupBy("c").agg(F.sum("links").alias("others"))

    def result(self, links: bool) -> DataFrame:
        parts = save(self.components(), "parts")
        known = self.classes.join(parts, "c", "left").withColumn("part", F.coalesce("part", "c"))
        least = known.groupBy("part").agg(F.min("class_id").alias("component_id"))
        known = known.join(least, "part").select("c", "class_id", "m", "component_id")
        if links:
            known = known.join(self.n_links(parts), "c", "left")
        return self.sets.join(save(known, "known"), "c", "left")


def join(docs: DataFrame, key: str, text: str, k: int = 3, threshold: int = 90, links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, class_id) of every row; n_links only if links is true.

    Two rows link when 100 * intersection >= threshold * union of their sets of k-word n-grams. component_id is the
    smallest doc_id that links reach, n_links the number of rows a row links with, class_id the smallest doc_id with an
    equal set. Rows without words, or with a null text, link with nothing, and their component is their own id. key: a
    column of integers. Rows are told apart by their sets, not by the key: rows with a null key, and several texts with
    one key, link like others; only null ids can't be the smallest, and where there are no others both ids are null.
    Repeated rows are copies. Sets are compared by 128 bits, n-grams by 64. threshold: 50 to 100.
    Without links the work does not grow with the square of a group of near copies; see the module's head.
    """
    found = _checked(docs, key, text, k, threshold).result(links)
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")]
    if links:
        columns.append(F.when(F.col("n") > 0, F.col("m") - 1 + F.coalesce("others", F.lit(0))).otherwise(0).alias("n_links"))
    return found.select(*columns, F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def _checked(docs: DataFrame, key: str, text: str, k: int, threshold: int) -> _Join:
    if not 50 <= threshold <= 100:
        raise ValueError("threshold must be 50 to 100 percent")
    return _Join(docs, key, text, Sets(k), threshold)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs, with their columns, less those of whose component another row has a smaller key. Rows with a null
    key stay, and so do several rows with one key and one text. Rows that go are few enough to broadcast, or each row of
    docs moves once."""
    found = _checked(docs, key, text, k, threshold).result(links=False)
    gone = found.where("n > 0 AND component_id < doc_id").select(F.col("doc_id").alias("_gone"), F.col("th").alias("_gone_text")).distinct()
    return docs.join(sized(save(gone, "gone")), (docs[key] == F.col("_gone")) & (F.xxhash64(docs[text]) == F.col("_gone_text")), "left_anti")


def op3(spark, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", 3, 90)


#: The same rows by the plain definition. It looks at pairs of documents that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN words ELSE list_slice(words, i, i + 2) END AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, least(len(words), 1) + 1))) AS i FROM w)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * o >= 90 * (ca.n + cb.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
e AS (SELECT x.doc_id, min(y.doc_id) AS class_id FROM (SELECT doc_id, list_sort(list(g)) AS gs FROM s GROUP BY doc_id) x JOIN (SELECT doc_id, list_sort(list(g)) AS gs FROM s GROUP BY doc_id) y USING (gs) GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, (SELECT count(*) FROM l WHERE l.a = w.doc_id)::BIGINT AS n_links, coalesce(class_id, w.doc_id) AS class_id
FROM w LEFT JOIN c USING (doc_id) JOIN m ON m.a = w.doc_id LEFT JOIN e ON e.doc_id = w.doc_id"""
