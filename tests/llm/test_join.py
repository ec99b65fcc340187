import random

import numpy as np
import pytest

from volframe.llm import ngram_join
from volframe.llm.components import connected_components

SPACES = " \t\n\x0b\x0c\r"


def words(t):
    for c in SPACES[1:]:
        t = t.replace(c, " ")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in t.split(" ") if w]


def shingles(t, k):
    w = words(t or "")
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, threshold):
    """(doc_id, set size, smallest reachable id, links) by looking at all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((key, len(sets[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), len(links[i])))
    return sorted(out, key=str)


def same(spark, rows, k, threshold):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.join(df, "doc_id", "text", k, threshold).collect()), key=str)
    assert got == brute(rows, k, threshold)


@pytest.mark.parametrize(("k", "threshold"), [(3, 90), (5, 80)])
def test_near_copies(spark, k, threshold):
    """Chains of near copies of several texts, of all lengths, with a passage that half of all texts share."""
    rng = random.Random(k)
    some = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    passage, rows = some(60), []
    for _ in range(25):
        base = some(rng.choice((1, 2, 4, 8, 20, 60, 150, 400)))
        if rng.random() < 0.5:
            base = base + passage
        for _ in range(rng.choice((1, 1, 3, 12, 30))):
            own = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 6))):
                at = rng.randrange(len(own))
                own[at : at + rng.choice((0, 1, 1))] = some(rng.choice((0, 1, 1)))
                own = own or some(1)
            if rng.random() < 0.3:
                base = own
            rows.append((len(rows), " ".join(own)))
    same(spark, rows, k, threshold)


@pytest.mark.parametrize("bits", [1, 3])
def test_sets_that_share_a_number(spark, bits):
    """Classes whose first numbers are the same, which 64 bits hardly ever are, are told apart by the second."""
    rng = random.Random(bits)
    some = lambda n: [f"w{rng.randint(0, 500)}" for _ in range(n)]
    bases = [some(rng.choice((1, 5, 40))) for _ in range(15)]
    rows = [(i, " ".join(some(1) + base[1:] if rng.random() < 0.3 else base)) for i, base in enumerate(bases * 5)] + [(99, ""), (98, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = ngram_join._Join(df, "doc_id", "text", ngram_join.Sets(2, bits=bits), 90)
    assert len(one.ways.doubled) > 2**bits // 2 and one.classes.count() == len({frozenset(shingles(t, 2)) for _, t in rows}) - 1
    got = [(r.doc_id, r.n, r.component_id if r.n else r.doc_id, r.m - 1 + (r.others or 0) if r.n else 0) for r in one.result(links=True).collect()]
    assert sorted(got, key=str) == brute(rows, 2, 90)


def test_odd_rows(spark, odd_rows):
    distinct = list({i: (i, t) for i, t in odd_rows if i is not None}.values()) + [r for r in odd_rows if r[0] is None]
    same(spark, distinct, 3, 90)


def test_clashing_columns(spark, odd, none):
    kept = ngram_join.keep_first(odd)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    assert ngram_join.keep_first(none).count() == 0 and ngram_join.join(none, "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        ngram_join.join(none, "doc_id", "text", 3, 10)


def some_sets(rng, threshold, trials=300):
    """Pairs of sets at and around the threshold."""
    for trial in range(trials):
        n = int(rng.integers(1, 60)) if trial % 2 else int(rng.integers(60, 400))
        universe = rng.integers(0, 2**63, 2 * n + 5).astype(np.uint64)
        a = np.sort(universe[:n])
        drop = rng.integers(0, max(1, n // 8) + 1)
        b = np.sort(np.concatenate([a[rng.permutation(n)[drop:]], universe[n : n + rng.integers(0, max(1, n // 8) + 1)]]))
        if len(b):
            o = len(np.intersect1d(a, b))
            yield (a, b) if len(a) <= len(b) else (b, a), o, 100 * o >= threshold * (len(a) + len(b) - o)


@pytest.mark.parametrize("threshold", [80, 90])
def test_prefixes_lose_no_pair(threshold):
    """Of two similar sets the smaller one's shorter prefix and the other's share an n-gram, whatever counts as common."""
    rng = np.random.default_rng(4)
    for pair, _, similar in some_sets(rng, threshold):
        if not similar:
            continue
        both = np.union1d(*pair)
        common = np.sort(rng.permutation(both)[: rng.integers(0, len(both) + 1)])
        longer, shorter, calm, tokens = ngram_join.prefixes(np.array([len(x) for x in pair]), np.concatenate(pair), threshold, common, rng.integers(1, 9000, len(common)))
        assert np.intersect1d(tokens[: shorter[0]], tokens[longer[0] :]).size and (calm <= longer).all() and (shorter <= longer).all()


@pytest.mark.parametrize("threshold", [80, 90])
def test_bitmaps_lose_no_pair(threshold):
    rng, dropped, unlike = np.random.default_rng(6), 0, 0
    for pair, o, similar in some_sets(rng, threshold):
        size, bits = ngram_join.bitmaps(np.array([len(x) for x in pair]), np.concatenate(pair))
        bound = ngram_join.possible(np.array([len(x) for x in pair]), [bits[: size[0]].tobytes(), bits[size[0] :].tobytes()], np.array([0]), np.array([1]), threshold)[0]
        assert bound >= o if similar else bound == -1 or bound >= o
        dropped, unlike = dropped + (bound < 0), unlike + (not similar)
    assert dropped > unlike / 2


def test_two_texts_of_one_key(spark):
    """Rows are told apart by their texts: links go through any of a key's texts, and only the text that repeats goes."""
    base, other = (" ".join(f"{x}{i}" for i in range(60)) for x in "wv")
    rows = [(1, base), (1, other), (2, base + " q"), (3, other + " q"), (4, base + " r"), (4, "own words that no other text has in it at all"), (None, other + " s")]
    same(spark, rows, 3, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(ngram_join.keep_first(df).collect(), key=str) == sorted(df.where("doc_id = 1 or doc_id is null or text like 'own%'").collect(), key=str)


@pytest.mark.parametrize("hot", [3, 10_000])
def test_tiles(spark, monkeypatch, hot):
    """Buckets of more classes than a tile holds, n-grams that count as hot, and more pairs than the earlier round takes."""
    monkeypatch.setattr(ngram_join, "TILE_SETS", 8)
    monkeypatch.setattr(ngram_join, "HOT_DOCS", hot)
    monkeypatch.setattr(ngram_join, "FIRST_PAIRS", (1,))
    monkeypatch.setattr(ngram_join, "HUB_SETS", 5)
    monkeypatch.setattr(ngram_join, "COUNT_NGRAMS", 300)
    rng = random.Random(hot)
    base, rows = [f"w{i}" for i in range(60)], []
    for kind in range(3):  # three groups around one text, too far apart to link, and loose ones between
        of = [f"y{kind}" if i % 9 == kind else w for i, w in enumerate(base)]
        for _ in range(30):
            own = list(of)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(base)
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df, "doc_id", "text", 3, 80, links=False).collect()), key=str)
    assert got == [x[:3] for x in brute(rows, 3, 80)] and 1 < len({x[2] for x in got}) < 80


def test_large_group(spark):
    """20,000 near copies of one text: one component, without looking at their pairs."""
    base = [f"w{i}" for i in range(70)]
    change = "transform(base, (w, i) -> IF(i = pmod(id * 7, 70), concat(w, 'x', id), w))"
    df = spark.range(1, 20_001).selectExpr("id", f"split('{' '.join(base)}', ' ') AS base").selectExpr("id AS doc_id", f"array_join({change}, ' ') AS text")
    found = ngram_join.join(df.unionByName(spark.createDataFrame([(0, " ".join(base)), (-5, "some other text altogether")], "doc_id long, text string")), "doc_id", "text", 3, 80, links=False)
    assert {tuple(r) for r in found.groupBy("component_id").count().collect()} == {(0, 20_001), (-5, 1)}


def test_blocks(spark, monkeypatch):
    """A cluster of more sets than a block holds."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"x{rng.randint(0, 40)}"
        rows.append((i, " ".join(own[: rng.randint(85, 100)])))
    same(spark, rows, 3, 90)


def test_empty_blocks(spark, monkeypatch):
    """Blocks are filled by hash: where some stay empty, no link counts twice."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: rng.randint(56, 60)], f"x{i}"])) for i in range(84)]
    blocks = -(-len(rows) // 4)
    filled = spark.range(len(rows)).selectExpr(f"pmod(xxhash64(id), {blocks}) AS block").distinct().count()
    assert filled < blocks
    same(spark, rows, 3, 90)


@pytest.mark.parametrize("k", [3, 5])
def test_few_words(spark, k):
    """Texts of fewer words altogether than an n-gram has."""
    for n in range(7):
        one = " ".join(f"w{i}" for i in range(n))
        sizes, grams = ngram_join.ngram_sets([one], k)
        assert sizes.tolist() == [len(shingles(one, k))] and len(grams) == sizes[0]
    df = spark.createDataFrame([(1, "one two"), (2, "One two")], "doc_id long, text string").coalesce(1)
    assert [r.doc_id for r in ngram_join.keep_first(df, k=k).collect()] == [1]


def test_overlaps(monkeypatch):
    monkeypatch.setattr(ngram_join, "FRAGMENT_NGRAMS", 7)
    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.integers(0, 50, rng.integers(0, 30))).astype(np.uint64) for _ in range(9)] for _ in range(2))
    assert ngram_join.overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components(spark, kind):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5), (3, None), (None, 3), (100, 101)]
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    form = (lambda x: x) if kind == "long" else (lambda x: None if x is None else f"n{x:04d}")
    low = {x: x for x in nodes}
    for _ in range(100):
        for a, b in edges:
            if a in low and b in low:
                low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame([(form(a), form(b)) for a, b in edges], f"a {kind}, b {kind}")
    assert {r.node: r.component for r in connected_components(df, "a", "b").collect()} == {form(k): form(v) for k, v in low.items()}
    assert connected_components(df.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("threshold", [80, 90])
def test_size_runs_part_no_pair(threshold):
    """Rows of one token that can be similar, one of them with the token in its shorter prefix, stay in one run."""
    rng, parted = np.random.default_rng(8), 0
    for _ in range(300):
        m = int(rng.integers(1, 25))
        token, n, short = rng.integers(0, 3, m), rng.integers(1, 60, m), rng.random(m) < rng.choice([0.2, 0.7])
        order = np.lexsort((~short, n, token))
        token, n, short = token[order], n[order], short[order]
        run = np.cumsum(ngram_join.size_runs(token, n, short, threshold))
        for i in range(m):
            for j in range(i + 1, m):
                near = token[i] == token[j] and 100 * n[i] >= threshold * n[j] and (short[i] or (short[j] and n[i] == n[j]))
                assert run[i] == run[j] if near else True
                parted += token[i] == token[j] and run[i] != run[j]
    assert parted > 300


@pytest.mark.parametrize("threshold", [80, 90])
def test_coarse_bitmaps_lose_no_pair(threshold):
    """Coarse bitmaps are foldings of the full ones, and as safe."""
    rng = np.random.default_rng(7)
    for pair, o, similar in some_sets(rng, threshold):
        sizes, grams = np.array([len(x) for x in pair]), np.concatenate(pair)
        full, coarse = ngram_join.bitmaps(sizes, grams), ngram_join.bitmaps(sizes, grams, threshold)
        fold = ngram_join._folded(full[1][: full[0][0]].reshape(1, -1), int(coarse[0][0]))
        assert fold.tobytes() == coarse[1][: coarse[0][0]].tobytes()
        maps = [coarse[1][: coarse[0][0]].tobytes(), coarse[1][coarse[0][0] :].tobytes()]
        bound = ngram_join.possible(sizes, maps, np.array([0]), np.array([1]), threshold)[0]
        assert bound >= o if similar else bound == -1 or bound >= o
