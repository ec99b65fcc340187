import random

import numpy as np
import pytest

from volframe.llm import minhash
from volframe.llm.ngram_join import Sets, ngram_sets

from .test_join import brute


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("k, threshold", [(4, 80), (1, 60), (5, 95)])
def test_odd_rows(spark, odd, odd_rows, k, threshold):
    rows = [(i, t) for i, t in odd_rows if i is not None]
    df = minhash.near_copies(odd.where("doc_id IS NOT NULL"), k=k, threshold=threshold)
    want = sorted({(i, n, low, i == low) for i, n, low, _ in brute(rows, k, threshold)}, key=str)
    assert sorted(set(result(df)), key=str) == want and df.count() == len(rows)


def test_sets_that_share_a_number(spark, odd, odd_rows):
    """A class's bitmaps and bands are made even where its task has met its first number on another set."""
    rows = [(i, t) for i, t in odd_rows if i is not None]
    one = minhash._NearCopies(odd.where("doc_id IS NOT NULL").coalesce(1), "doc_id", "text", Sets(4, bits=2), 80, 20, 3)
    assert len(one.ways.doubled) == 4 and one.sketched.select("c").distinct().count() == one.classes.count()
    got = {(r.doc_id, r.n, r.component_id if r.n else r.doc_id) for r in one.result(links=False).collect()}
    assert got == {(i, n, low) for i, n, low, _ in brute(rows, 4, 80)}


def test_null_keys(spark, odd, odd_rows):
    found = [r for r in minhash.near_copies(odd, k=4).collect() if r.doc_id is None]
    assert len(found) == 2 and {(r.n_shingles > 0, r.component_id, r.kept) for r in found} == {(True, 6, False), (False, None, True)}


def test_nothing(spark, none):
    assert minhash.near_copies(none).count() == 0
    with pytest.raises(ValueError):
        minhash.near_copies(none, threshold=40)


def test_links_that_stars_leave_open(spark):
    """Chains of texts that share nearly all words: the ends are unlike, and a bucket's star misses links between others."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(6):
        base = rng.sample(words, 60)
        for _ in range(25):
            at = rng.randrange(60)
            base = base[:at] + [rng.choice(words)] + base[at + 1 :]
            rows.append((n, " ".join(base)))
            n += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(minhash.near_copies(df, k=2, threshold=90)) == sorted(((i, m, low, i == low) for i, m, low, _ in brute(rows, 2, 90)), key=str)


def test_sketches():
    """A bin holds the smallest hash of its own, and an empty one the value that its order of the others finds first."""
    sizes, grams = ngram_sets(["", "one", "one two three four five six", " ".join(map(str, range(2000))), *(" ".join(map(str, range(n))) for n in range(1, 30))], 1)
    bins, at = 40, 0
    got = minhash.sketches(sizes, grams, bins)
    for n, row in zip(sizes.tolist(), got, strict=True):
        own = grams[at : at + n].tolist()
        at += n
        full = {}
        for g in own:
            b = (g >> 32) * bins >> 32
            full[b] = min(g, full.get(b, g))
        want = [full[next(x for x in minhash._lenders(bins)[b] if x in full)] if b not in full else full[b] for b in range(bins)] if full else [0] * bins
        assert row.tolist() == want


@pytest.mark.parametrize("n", [5, 10, 60, 300, 2000])
def test_bands_catch_pairs_at_the_threshold(n):
    rng = np.random.default_rng(n)
    bands, hits = minhash.bands_for(80), []
    for _ in range(60):
        u = rng.integers(1, 2**63, n, np.uint64) * np.uint64(2)
        part = n - round(0.8 * n)
        a, b = np.sort(u[: n - part // 2]), np.sort(u[part - part // 2 :])
        keys = minhash.band_keys(minhash.sketches(np.array([len(a), len(b)]), np.concatenate([a, b]), bands * minhash.BAND_BINS), minhash.BAND_BINS)
        hits.append((keys[0] == keys[1]).sum())
    assert min(hits) > 0 and abs(np.mean(hits) / bands - 0.8**minhash.BAND_BINS) < 0.05
    assert (1 - 0.8**minhash.BAND_BINS) ** bands <= minhash.MISS


def test_stars_bound_the_pairs(spark):
    """300 unlike rewordings of one text: pairs looked at grow with the classes of a bucket, not with their square."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"x{rng.random()}" for w in base)) for i in range(300)]
    found = minhash._NearCopies(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 1, 80, minhash.bands_for(80), minhash.BAND_BINS)
    buckets, _ = found.buckets()
    assert found.stars(buckets).count() <= minhash.STARS * buckets.select("c").distinct().count()
