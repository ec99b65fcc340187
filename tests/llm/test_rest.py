import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from volframe.llm import compression_classifier, media, quality_rules, sharding, url_filters, warc


def test_rules_order_never_changes_the_verdict(spark, odd):
    kept = {(r.doc_id, r.text) for r in quality_rules.keep_good(odd).collect()}
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1]):
        assert {(r.doc_id, r.text) for r in quality_rules.cascade(odd, rules).where("rejected_by IS NULL").collect()} == kept
    judged = quality_rules.judge(odd)
    assert judged.where("kept").select("doc_id").distinct().count() == len({i for i, _ in kept})
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_cascade_stops_early(spark):
    first, second = quality_rules.Rule("all", "true", ()), quality_rules.Rule("never", "raise_error('asked') IS NULL", ())
    df = spark.createDataFrame([("x",), (None,)], "text string")
    assert [r.rejected_by for r in quality_rules.cascade(df, [first, second]).collect()] == ["all", "all"]
    cheap, dear = quality_rules.Rule("all", "true", ("n_words",)), quality_rules.Rule("never", "true", ("n_lines",))
    order = quality_rules.ordered(quality_rules.Estimates((cheap, dear), {"n_words": 1.0, "n_lines": 10.0}, {frozenset(("all",)): 1, frozenset(("never",)): 2}))
    assert [r.name for r in order] == ["all", "never"]


def test_order_is_by_rejections_left_per_cost():
    """A rule that rejects only what an earlier one rejects goes last, though it is cheap."""
    a, b, c = (quality_rules.Rule(x, "true", (n,)) for x, n in (("a", "n_symbols"), ("b", "_words"), ("c", "_lines")))
    found = quality_rules.Estimates((a, b, c), {"n_symbols": 1.0, "_words": 1.2, "_lines": 9.0}, {frozenset("ab"): 50, frozenset("c"): 5, frozenset(): 100})
    assert [r.name for r in quality_rules.ordered(found)] == ["a", "c", "b"]


def test_a_rule_costs_what_it_adds():
    """A measure that an earlier rule asked for, or that is there before the cascade, costs nothing more."""
    a, b, c = (quality_rules.Rule(x, "true", n) for x, n in (("a", ("n_words",)), ("b", ("n_words", "n_symbols")), ("c", ("n_lines",))))
    cost = {"_words": 5.0, "n_words": 0.1, "n_symbols": 0.2, "_lines": 3.0, "n_lines": 0.1}
    found = quality_rules.Estimates((a, b, c), cost, {frozenset("a"): 20, frozenset("b"): 9, frozenset("c"): 10, frozenset(): 61})
    assert [round(found.adds(r, ()), 3) for r in (a, b, c)] == [5.1, 5.3, 3.1]
    assert [r.name for r in quality_rules.ordered(found)] == ["a", "b", "c"]  # alone, b would go after c
    assert [r.name for r in quality_rules.ordered(found, ("n_lines", "_lines"))] == ["c", "a", "b"]


def test_measured_costs_set_the_order(spark):
    """A dear rule with slightly more rejections goes after a cheap one, by costs measured on the rows."""
    import random as r

    rng = r.Random(9)
    rows = [(i, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(800))) for i in range(150)]
    rows += [(1000 + i, "same five words again here " * 200) for i in range(12)] + [(2000 + i, "# " * 900) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = tuple(x for x in quality_rules.RULES if x.name in ("repeats", "symbols"))
    found = quality_rules.estimate(docs, rules, sample_rows=10_000)
    rejected = {x.name: sum(n for f, n in found.failing.items() if x.name in f) for x in rules}
    assert rejected == {"repeats": 22, "symbols": 10} and sum(found.failing.values()) == 172
    assert found.adds(rules[0], ()) > 3 * found.adds(rules[1], ("_words", "n_words"))
    assert found.cost["n_repeat_words"] + found.cost["_grams"] > 3 * found.cost["n_symbols"] > 0 and found.cost["n_repeat_words"] > 5 * found.cost["n_words"]
    assert [x.name for x in quality_rules.ordered(found, ("_words", "n_words"))] == ["symbols", "repeats"]


def test_sample_comes_from_some_files(spark, tmp_path):
    spark.range(4000).selectExpr("id AS doc_id", "concat('a b ', id) AS text").repartition(40).write.parquet(f"{tmp_path}/many")
    docs = spark.read.parquet(f"{tmp_path}/many")
    some = quality_rules._of_some_files(docs, 0.1)
    assert 1000 < some.count() < 2500 and some.select(F.input_file_name()).distinct().count() == quality_rules.SAMPLE_FILES
    assert quality_rules._of_some_files(docs.groupBy("doc_id").agg(F.max("text").alias("text")), 0.1).count() == 4000
    assert 500 < sum(quality_rules.estimate(docs).failing.values()) < 1600


def test_rules_cost(odd):
    found = quality_rules.estimate(odd, sample_rows=10_000)
    assert sum(found.failing.values()) == odd.count() and min(found.cost.values()) > 0 and found.cost["n_repeat_words"] > found.cost["n_words"]


def test_rules_on_nothing(none):
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def jump(key, n):
    """The published algorithm."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 100])
def test_jump_hash(spark, shards):
    df = spark.range(3000).withColumn("h", F.xxhash64("id")).withColumn("s", sharding.jump_hash("id", shards))
    assert all(r.s == jump(r.h % 2**64, shards) for r in df.collect())


def test_shards_grow(spark, odd):
    rows = sharding.assign(odd.select("doc_id", "text", "n"), "doc_id", 5).collect()
    assert len(rows) == odd.count() and all(r.grown_shard in (r.shard, 5) for r in rows)
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    with pytest.raises(ValueError):
        sharding.jump_hash("doc_id", 0)


def test_shards_of_nothing(none):
    assert sharding.assign(none.select("doc_id", "text"), "doc_id", 5).count() == 0


def test_images():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50):
        payload = rng.integers(0, 256, 576 * n).astype(np.uint8).tobytes()
        assert media.from_image(media.to_image(payload)) == payload


def test_media(spark, odd, odd_rows, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/media"
    media.store(odd, "doc_id", "text", at)
    got = spark.read.format("media_archives").schema("key string, n_bytes long, payload binary, payload_sha256 string, tail_crc32 long, media_bytes long, feature string").load(at).collect()
    want = []
    for i, t in odd_rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((str(i), len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted((str(r.key), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_sha256 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in by.values())


def test_media_keys(spark, tmp_path):
    """Keys come back as they were: null, empty, with a slash or a zero byte."""
    keys = [None, "", "a\x00b", "a/b", "é%2F", ".png"]
    media.store(spark.createDataFrame([(k, "x") for k in keys], "k string, text string"), "k", "text", f"file://{tmp_path}/k")
    assert sorted((r.key for r in spark.read.format("media_archives").load(f"file://{tmp_path}/k").collect()), key=str) == sorted(keys, key=str)


def test_records_of_any_time():
    for at in (-(2**63), -1, 0, 10**12, 2**63 - 1):
        assert warc._parsed(warc._record("http://a/", at, "k", b"x" * 9, hashlib.sha256(b"x" * 9).hexdigest(), None))["payload_bytes"] == 9


def test_shared_root_has_a_scheme(spark):
    from volframe.llm import shared

    for given, want in (("/tmp/x/", "file:///tmp/x"), ("file:/tmp/x", "file:///tmp/x"), ("s3a://b/x", "s3a://b/x")):
        assert shared.qualified(spark, given) == want


def test_media_tries_a_member_again(tmp_path):
    """A member that comes damaged is read again on its own; one that stays damaged is an error."""
    import zipfile

    image = media.to_image(b"x" * 576)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("0/576/7.png", image)
        info = z.infolist()[0]

    class Bad(media.Opened):
        left = 2

        def at(self, offset, size):
            self.left -= 1
            return b"" if self.left >= 0 else super().at(offset, size)

    from pyarrow import fs

    opened = Bad(fs.LocalFileSystem(), str(tmp_path / "a.zip"))
    assert media.ArchiveReader.member(opened, info.header_offset, info.file_size, info.CRC) == image
    with pytest.raises(OSError):
        media.ArchiveReader.member(media.Opened(fs.LocalFileSystem(), str(tmp_path / "a.zip")), info.header_offset, info.file_size, info.CRC + 1)


def test_media_of_nothing(spark, none, tmp_path):
    media.store(none, "doc_id", "text", f"file://{tmp_path}/m")
    assert spark.read.format("media_archives").load(f"file://{tmp_path}/m").count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randint(0, 9), i) for _ in range(rng.randint(0, 20))) for i in range(k)]
        merged = list(warc.LoserTree([iter(r) for r in runs], key=lambda x: x[0]))
        assert merged == sorted((x for r in runs for x in r), key=lambda x: (x[0], x[1]))


def test_histories_are_ordered(spark):
    rows = [(f"k{random.Random(i).randint(0, 5)}", i % 3, str(i), f"run{i % 4}") for i in range(400)] + [(None, None, "n", "run0")]
    df = spark.createDataFrame(rows, "url_key string, captured_at long, page_key string, archive string")
    by = ("url_key", "captured_at", "page_key")
    want = sorted([r[:3] for r in rows], key=lambda x: [(v is not None, v) for v in x])
    for range_rows, fan_in in ((10**6, 128), (30, 128), (30, 2), (1, 3)):
        merged = warc.merge(df.repartition(9), by, range_rows, fan_in)
        assert [(r.url_key, r.captured_at, r.page_key) for r in merged.collect()] == want and merged.columns == df.columns
    assert merged.rdd.getNumPartitions() > 100  # one for each range
    assert warc.merge(df.where("false"), by).collect() == []


def test_a_merge_holds_a_batch_of_each_run(tmp_path):
    """What a merge of sorted files holds does not grow with their rows."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.parquet as pq

    names, peak = ["k", "v"], {}
    for n in (20_000, 200_000):
        for run in range(4):
            pq.write_table(pa.table({"k": [f"{i:08d}" for i in range(run, n, 4)], "v": list(range(run, n, 4))}), tmp_path / f"{n}-{run}", row_group_size=5000)
        key = warc._key_of(names, ["k"])
        tracemalloc.start()
        low, high = key(("00001000", 0)), key((f"{n - 1000:08d}", 0))
        merged = warc.LoserTree([warc._within(f"file://{tmp_path}/{n}-{r}", names, key, low, high) for r in range(4)], key)
        assert sum(1 for i, row in enumerate(merged) if row[1] == i + 1000) == n - 2000
        peak[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peak[200_000] < 1.5 * peak[20_000]


def test_null_and_repeated_ids(spark):
    body = b"x" * 100
    rows = [(None, body), (7, body), (7, body), (9, body), (None, b"y" * 100), (None, b"y" * 100), (3, b"short"), (4, b"short"), (5, None)]
    df = spark.createDataFrame(rows, "page_id long, p binary")
    got = sorted(((r.page_id, r.payload_bytes, r.refers_to) for r in warc.revisits(df, "page_id", F.col("p")).collect()), key=str)
    assert got == sorted([(None, 100, 7), (7, 100, None), (7, 100, None), (9, 100, 7), (None, 100, None), (None, 100, None), (3, 5, None), (4, 5, None), (5, 0, None)], key=str)


def test_rules_of_longest_match(spark):
    df = spark.createDataFrame([(1, "b.example.net", "/en/x"), (2, "example.net", "/de/"), (3, "notexample.net", "/"), (4, "net", ""), (5, "", "")], "k long, host string, path string")
    got = {r.k: (r.rule, r.rule_verdict) for r in url_filters.match_rules(df, url_filters.rule_table(spark), "k").collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: ("net/", "block")}


def test_classes_take_decisions(spark):
    pages = spark.createDataFrame([(1, "http://a.info/"), (2, "http://b.info/"), (3, "http://c.info/"), (4, "http://x.net/"), (5, "http://y.org/fr/"), (None, None), (6, "http://alone.info/")], "page_id long, url string")
    edges = spark.createDataFrame([("http://a.info/", "http://x.net/"), ("http://b.info/", "http://x.net/"), ("http://c.info/", "http://y.org/fr/"), ("http://y.org/fr/", "http://far.net/")], "a string, b string")
    got = {r.page_id: r.verdict for r in url_filters.filter_urls(pages, url_filters.rule_table(spark), edges).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", None: "allow", 6: "allow"}


@pytest.mark.parametrize("target", ["http://b.info/1", "HTTP://B.info:80/1#part", "//b.info/x/../1", "http://b.info/./1?", "http://b.info/0/.././1"])
def test_aliases_of_a_blocked_url(spark, target):
    """However a page writes its address and its links, a decision on the class reaches it."""
    link = lambda to: f'<link rel="stylesheet" href="/s.css"><link href="{to}" rel="canonical"><LINK REL=canonical HREF=http://bad.net/x>'
    pages = [(1, "http://b.info/1", link("http://bad.net/x")), (2, "HTTP://b.info/1", ""), (3, "http://b.info/1#f", ""), (4, "http://b.info:80/1", ""), (5, "http://c.info/deep/page.html?q", link(target.removesuffix("?")))]
    pages += [(6, "http://c.info/deep/other", '<link rel=canonical href=page.html?q>'), (7, "http://c.info/deep/", '<link rel=canonical href="?x=1&amp;y=2">'), (8, "http://c.info/deep/?x=1&y=2", '<meta http-equiv=refresh content="0;url=../deep/other">')]
    pages += [(9, "http://free.info/", '<link rel=canonical href="mailto:x@bad.net">'), (10, "http://free.info/#a", '<link rel=canonical href="#b">'), (11, "no scheme", link(target)), (12, None, None), (13, "http://free.info/b", "<link rel=next href=http://bad.net/x>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filters.filter_urls(df, url_filters.rule_table(spark), url_filters.links(df)).collect()}
    assert got == {i: "block" for i in range(1, 9)} | {i: "allow" for i in range(9, 14)}


def test_classifier_tells_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    rows = compression_classifier.op6(spark, d).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.75 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([s >= 0.3 for s in good]) > 0.95


def test_scores_are_the_calibrated_difference_alone(spark, odd, odd_rows):
    """By hand: two plain compressors, windows of the whole text, one difference a byte, one slope and one constant."""
    import zstandard

    m = compression_classifier.Model(" ".join(t for i, t in odd_rows[20:50] if t).encode(), b"same line\nother words " * 40, (3.0, 0.5))
    of = lambda d: zstandard.ZstdCompressor(level=12, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
    good, bad = of(m.good), of(m.bad)
    want = []
    for i, t in odd_rows:
        raw = (t or "").encode()
        away = sum(len(bad.compress(raw[a : a + 300])) - len(good.compress(raw[a : a + 300])) for a in range(0, len(raw), 300))
        x = away / len(raw) if raw else 0.0
        want.append((i, 1 / (1 + np.exp(-(m.weights[0] * x + m.weights[1])))))
    got = [(r.doc_id, r.score) for r in compression_classifier.score(odd, m).select("doc_id", "score").collect()]
    order = lambda v: sorted(v, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert len({round(s, 6) for _, s in got}) > 30
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 for a, b in zip(order(got), order(want), strict=True))


def test_the_registered_classifier(spark, tables):
    """One row a document, the held-out fifth by crc32 of the id, predicted at 0.3, equal texts with equal scores."""
    rows = compression_classifier.op6(spark, tables).collect()
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    assert len(rows) == len(docs) and rows[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    text = {d.doc_id: d.text or "" for d in docs if d.doc_id is not None}
    by = {}
    for r in rows:
        if r.doc_id is not None:
            by.setdefault(text[r.doc_id], set()).add(r.score)
    assert all(len(v) == 1 for v in by.values())


def test_classifier_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(60)] + [(6, None), (None, 1)], "doc_id long, quality int")
    model = compression_classifier.fit(odd, labels)
    scored = compression_classifier.score(odd, model)
    assert scored.columns == [*odd.columns, "score"] and all(0 <= r.score <= 1 for r in scored.collect())
    assert compression_classifier.score(none, model).count() == 0
    only = compression_classifier.fit(odd, labels.where("quality = 1"))
    assert all(r.score > 0.5 for r in compression_classifier.score(odd, only).collect())
    assert all(0 <= r.score <= 1 for r in compression_classifier.score(odd, compression_classifier.fit(none, labels)).collect())


def test_classifier_keeps_the_labels_shares(spark):
    """The bound on the sample is for each label; scores keep the shares that the labels have in all rows."""
    rng = random.Random(4)
    kinds = [int(i % 10 > 0) for i in range(600)]
    word = lambda v: rng.choice((f"good{rng.randint(0, 300)}", f"bad{rng.randint(0, 300)}")[:: 1 if rng.random() < 0.55 + 0.1 * v else -1])
    docs = spark.createDataFrame([(i, " ".join(word(v) for _ in range(60))) for i, v in enumerate(kinds)], "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(kinds)), "doc_id long, quality int")
    for most in (40, 1200):
        mean = np.mean([r.score for r in compression_classifier.score(docs, compression_classifier.fit(docs, labels, sample_texts=most)).collect()])
        assert abs(mean - 0.9) < 0.1
