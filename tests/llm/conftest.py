"""A small table with what the operators must stand: nulls, empty and very long texts, ties, repeats, clashing names."""

import random

import pytest

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "hé", "ja", "Ke") for b in ("n", "r", "st", "lm", "x", "ß", "", "t.")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(7)
    base = text(rng, 120)
    near = [" ".join(w if rng.random() > 0.01 else "new" for w in base.split()) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate([None, "", " \n\t", "one", "One", "one two", base, base, base.upper(), text(rng, 20_000), "a\n\na\n\nb", "é▁😀  x\u00a0y\x00z", "same line\n" * 30, "### " * 50, *near])]
    rows += [(100 + i, text(rng, rng.randint(1, 200))) for i in range(60)]
    rows += [(i, t) for i, t in rows[:3]] + [(None, base), (None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    rows = [(i, t, "xx", None, -1, "extra", 5, "b") for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, n long, _key string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def tables(spark, odd_rows, tmp_path_factory):
    """The odd rows and their like as a folder of tables, for the registered queries."""
    rng = random.Random(3)
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in odd_rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(100 + i, i % 4 and 1, 0) for i in range(60)] + [(6, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    hosts = ("a.example.net", "EXAMPLE.com", "x.org", "net", "plain.info")
    pages = [(i, f"https://{rng.choice(hosts)}{rng.choice(('', '/', '/en/', '/en/a?b#c', '/de/x', '/fr/'))}", text(rng, 40)) for i in range(40)]
    link = lambda to: f'<html><link rel="canonical" href="{to}"> {text(rng, 30)}'
    pages += [(40, "http://one.info/a", link("http://bad.net/")), (41, "http://two.info/", link("//one.info/a")), (42, "http://three.info/", link("/same")), (43, "http://three.info/same", "x")]
    pages += [(44, "http://four.info/", link("https://q.example.net/en/")), (45, "https://q.example.net/en/", link("http://r.net/")), (46, "http://five.info/", '<meta http-equiv="refresh" content="0; url=http://bad.net/">')]
    pages += [(47, None, None), (48, "no scheme", ""), (49, "a://b://c/d", pages[0][2]), (50, "http://z.org/", pages[0][2]), (51, "http://z.org/", pages[0][2]), (52, "http://k.org/", "short"), (53, "http://k.org/", "short")]
    pages += [(60, "http://six.info/a/b", link("../c?x=1&amp;y=2")), (61, "http://six.info/c?x=1&y=2", "<meta http-equiv='refresh' content='1; URL=//BAD.net:80/z#top'>"), (62, "HTTP://SIX.info:80/a/./b#f", ""), (63, "http://six.info", link("a/b") + link("mailto:a@b"))]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{at}/pages.parquet")
    return f"{at}"
