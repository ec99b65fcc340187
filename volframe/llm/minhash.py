"""Near copies by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

1. Sketch. The hashes of a set's n-grams are dealt to bins by their high bits, and each bin keeps its smallest: one pass
   over the set gives the whole sketch. An empty bin takes the value of a full one, chosen by the bin's own random order of
   all bins, the same for every set, so that two sets agree in a bin with a chance equal to their similarity.
2. Buckets. A band is some bins next to each other; the classes (texts with equal sets) that agree in a whole band are a
   bucket. Buckets of the same classes count once.
3. Candidates. A bucket is a star around the class that shares most buckets with others: of a text and its rewordings that
   is the text, as each rewording keeps other bands of it. Of the stars that a class lies in it takes the STARS with the
   most shared centres, so that m classes give no more than STARS * m pairs, however many bands they have in common.
   Pairs pass the parity bitmaps of the n-gram join and are then confirmed on full sets.
4. What the stars leave open. Classes of one bucket that are in different components after that may still link with each
   other; the join's later rounds look at those pairs alone, each in one of the buckets it has in common, so that a
   component is the one of all links.

A pair at the threshold agrees in no band at all with a chance of MISS; more similar pairs with less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .ngram_join import FIRST_PAIRS, Sets, _binary, _Join, _mix, _Once, _runs_of, _texts, bitmaps, told_apart
from .shared import discard, giving_back, read, save, sized

#: Bins of a band; the chance that a pair at the threshold has no band in common; stars that a class is a point of.
BAND_BINS, MISS, STARS = 5, 1e-10, 2
#: Sets whose sketches are made at a time; lenders that all empty bins ask together before sets go on one at a time.
SKETCHES, TURNS = 2048, 24
U = np.uint64


def bands_for(threshold: int, band_bins: int = BAND_BINS, miss: float = MISS) -> int:
    """How many bands it takes for a pair at the threshold (percent) to miss all of them with that chance."""
    agree = (threshold / 100) ** band_bins
    return 1 if agree == 1 else math.ceil(math.log(miss) / math.log(1 - agree))


@lru_cache(maxsize=4)
def _lenders(bins: int) -> np.ndarray:
    """[bin, i]: the bin that an empty bin asks as the i-th, a random order of all bins for each."""
    return np.random.default_rng(bins).permuted(np.tile(np.arange(bins, dtype=np.int32), (bins, 1)), axis=1)


@lru_cache(maxsize=4)
def _places(bins: int) -> np.ndarray:
    """[bin, lender]: as the how manieth the lender is asked."""
    return np.argsort(_lenders(bins), axis=1).astype(np.int32)


def sketches(sizes: np.ndarray, grams: np.ndarray, bins: int) -> np.ndarray:
    """[set, bin] for sets whose n-grams lie on end, each set ascending; an empty set has zeros."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cell = owner * bins + ((grams >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    out, full = np.zeros((len(sizes), bins), np.uint64), np.zeros((len(sizes), bins), bool)
    out.ravel()[cell[first]] = grams[first]
    full.ravel()[cell[first]] = True
    row, bin_ = np.nonzero(~full & (sizes > 0)[:, None])
    asked, turn = _lenders(bins), 0
    while len(row) and turn < TURNS:
        lender = asked[bin_, turn]
        found = full[row, lender]
        out[row[found], bin_[found]] = out[row[found], lender[found]]
        row, bin_, turn = row[~found], bin_[~found], turn + 1
    left = np.unique(row)  # few of their bins are full: which of those comes first in each bin's order
    many = full[left].sum(1)
    for m in np.unique(many):
        some = left[many == m]
        step = max(1, 4_000_000 // int(bins * m))
        for at in range(0, len(some), step):
            r = some[at : at + step]
            has = np.nonzero(full[r])[1].reshape(-1, m)
            first = np.take_along_axis(has, _places(bins)[:, has].argmin(2).T, 1)
            out[r] = np.where(full[r], out[r], np.take_along_axis(out[r], first, 1))
    return out


def band_keys(sketch: np.ndarray, band_bins: int) -> np.ndarray:
    """[set, band]: a 64-bit key of the band's number and bins."""
    parts = sketch.reshape(len(sketch), -1, band_bins)
    key = np.broadcast_to(_mix(np.arange(1, parts.shape[1] + 1, dtype=np.uint64)), parts.shape[:2])
    for j in range(band_bins):
        key = _mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


SKETCHED = "doc_id long, th long, n long, c long, d long, bits binary, coarse binary, bands array<long>"


def _sketched(batches: Iterator[pa.RecordBatch], ways: Sets, threshold: int, bands: int, band_bins: int) -> Iterator[pa.RecordBatch]:
    """A row for each document; the first of a class in a task has the class's bitmaps and bands too."""
    once, other = _Once(), _Once()
    for b in batches:
        for at, run in _runs_of(_texts(b)):
            sizes, grams, *numbers = ways.both(run)
            c, d = (x.view(np.int64) for x in numbers)
            new = (once.new(c) | other.new(d)) & (sizes > 0)
            own, of = sizes[new], grams[np.repeat(new, sizes)]
            ends = np.cumsum(own)
            keys = [np.zeros((0, bands), np.int64)]
            for i in range(0, len(own), SKETCHES):
                some = own[i : i + SKETCHES]
                keys.append(band_keys(sketches(some, of[ends[i] - own[i] : ends[i + len(some) - 1]], bands * band_bins), band_bins))
            keys = np.concatenate(keys)
            place = pa.array(np.where(new, np.cumsum(new) - 1, 0), mask=~new)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            wide = [x.take(place) for x in (_binary(*bitmaps(own, of)), _binary(*bitmaps(own, of, threshold)), lists)]
            columns = [b.column(0).slice(at, len(run)), b.column(2).slice(at, len(run)), pa.array(sizes.astype(np.int64)), *(pa.array(x, mask=sizes == 0) for x in (c, d)), *wide]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n", "c", "d", "bits", "coarse", "bands"])


class _NearCopies(_Join):
    """The join's steps from pairs on, over buckets of bands."""

    def __init__(self, docs: DataFrame, key: str, text: str, ways: Sets | int, threshold: int, bands: int, band_bins: int):
        ways = ways if isinstance(ways, Sets) else Sets(ways)  # a number is that of the words of an n-gram
        self.threshold = threshold
        self.rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
        described = save(self.rows.mapInArrow(giving_back(lambda it: _sketched(it, ways, threshold, bands, band_bins)), SKETCHED), "sketches")
        described, self.classes, self.ways = told_apart(described, ways)
        self.sets = described.select("doc_id", "th", "n", "c")
        self.sketched = described.where("bands IS NOT NULL").select("c", "n", "bits", "coarse", "bands")

    def buckets(self) -> tuple[DataFrame, DataFrame]:
        """(bucket, c, ns): the classes of each band key that several have, one key for all that have the same classes; and
        (c, n, bits, coarse, mine) of these classes, mine being a class's buckets. Keys are pre-aggregated, so that no bucket
        is gathered."""
        each = self.sketched.select("c", (F.col("n") * 2 + 1).alias("ns"), F.explode("bands").alias("bucket"))
        h = F.xxhash64("c")
        what = each.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(2**31 - 1)).alias("s"))
        shared = save(what.where("low < high").groupBy("low", "high", "m", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket"), "shared")
        found = save(each.join(sized(shared), "bucket").select("bucket", "c", "ns").distinct(), "buckets")
        discard(shared)
        own = found.groupBy("c").agg(F.collect_list("bucket").alias("mine"))  # at most one a band
        bits = self.sketched.select("c", "n", "bits", "coarse").join(own.select("c"), "c", "left_semi").groupBy("c").agg(*(F.min(x).alias(x) for x in ("n", "bits", "coarse")))
        return found, save(bits.join(own, "c"), "bitmaps")

    def stars(self, buckets: DataFrame) -> DataFrame:
        """(a, b), a < b: each class with the STARS centres of its buckets that share most; the smaller class where two
        share as much."""
        shares = buckets.groupBy("c").agg(F.count("*").alias("shares"))
        rank = F.struct(-F.col("shares"), F.col("c"))  # the smallest is the centre
        ranked = buckets.select("bucket", "c").join(shares, "c").select("bucket", "c", rank.alias("rank"))
        centres = ranked.groupBy("bucket").agg(F.min("rank").alias("centre"))
        around = buckets.select("bucket", "c").join(centres, "bucket").where("c <> centre.c").groupBy("c").agg(F.slice(F.array_sort(F.collect_set("centre")), 1, STARS).alias("centres"))  # at most one a band
        return around.select(F.explode("centres.c").alias("x"), "c").select(F.least("x", "c").alias("a"), F.greatest("x", "c").alias("b")).distinct()

    def components(self) -> DataFrame:
        """(c, part) of every class that links with another; part is the smallest class that links reach."""
        buckets, bits = self.buckets()
        hung = lambda edges: connected_components(edges, "a", "b").select(F.col("node").alias("c"), F.col("component").alias("part"))
        stars = save(self.stars(buckets), "stars")
        near = save(self.filtered(stars, bits, "coarse").select("a", "b"), "coarse_pairs")
        pairs = save(self.filtered(near, bits), "pairs")
        links = self.verified(pairs)
        parts = save(hung(links), "parts")
        for table in (near, pairs, links):
            discard(table)
        left, asked = buckets, stars
        for most in (*FIRST_PAIRS, 2**62):
            now = save(left.join(parts, "c", "left").withColumn("part", F.coalesce("part", "c")), "placed")
            found = save(self.across(now, bits, most), "across")
            near = save(found.select("a", "b").distinct().join(asked, ["a", "b"], "left_anti"), "coarse_pairs")
            pairs = save(self.filtered(near, bits), "pairs")
            new = self.verified(pairs)
            if not new.isEmpty():  # known components go on as stars
                parts = save(hung(new.unionByName(parts.select(F.col("part").alias("a"), F.col("c").alias("b")))), "parts")
            back = found.where("held_back").select("bucket").distinct()
            if back.isEmpty():
                break
            left, asked = buckets.join(back, "bucket", "left_semi"), asked.unionByName(near)
            for table in (now, pairs, new):
                discard(table)
        for table in (buckets, bits, stars):
            discard(table)
        return parts


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: int = 80, bands: int | None = None, band_bins: int = BAND_BINS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id) of every row.

    Words are what ASCII white space separates, A-Z in lower case; a row's set is its distinct n-grams of k words (the whole
    sequence, if there are fewer words). Two rows link when 100 * intersection >= threshold * union, confirmed on full
    sets. component_id is the smallest doc_id that links reach, class_id the smallest with an equal set; kept says that
    the row's id is the component's. Null texts and texts without words have the empty set, link with nothing and are kept.
    Repeated rows are copies; of rows with one id all are kept or none. A null id is never the smallest; where a component
    has no other id, both are null and the row is kept. Other columns are not looked at. bands: as many as a pair at
    the threshold needs, by default.
    """
    if not 50 <= threshold <= 100:
        raise ValueError("threshold must be 50 to 100 percent")
    found = _NearCopies(docs, key, text, Sets(k), threshold, bands or bands_for(threshold, band_bins), band_bins).result(links=False)
    least = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), least.alias("component_id"), F.col("doc_id").eqNullSafe(least).alias("kept"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
    )


def op13(spark, sf_dir: str) -> DataFrame:
    return near_copies(read(spark, sf_dir, "documents", "doc_id", "text"), k=4, threshold=80)


#: The same rows by the plain definition. It looks at pairs of different sets that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN words ELSE list_slice(words, i, i + 3) END AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, least(len(words), 1) + 1))) AS i FROM w)),
d AS (SELECT doc_id, list_sort(list(g)) AS gs, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT gs, min(doc_id) AS class_id, min(n) AS n FROM d GROUP BY gs),
k AS MATERIALIZED (SELECT class_id, unnest(gs) AS g FROM e),
p AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS o FROM k x JOIN k y ON x.g = y.g AND x.class_id <> y.class_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN e ea ON ea.class_id = a JOIN e eb ON eb.class_id = b WHERE 100 * o >= 80 * (ea.n + eb.n - o)),
r(a, b) AS (SELECT class_id, class_id FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
f AS (SELECT d.doc_id, d.n, e.class_id, m.component_id FROM d JOIN e USING (gs) JOIN m ON m.a = e.class_id)
SELECT w.doc_id, coalesce(f.n, 0)::BIGINT AS n_shingles, coalesce(f.component_id, w.doc_id) AS component_id, coalesce(f.component_id, w.doc_id) = w.doc_id AS kept, coalesce(f.class_id, w.doc_id) AS class_id
FROM w LEFT JOIN f USING (doc_id)"""
