"""Quality rules and URL filters against their SQL and brute force, at small sizes."""

import duckdb
import pytest

from tessera.llm import quality_rules as R
from tessera.llm import url_rules as U

SF = "/root/testdata/sf0.001"


def _duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    return con.execute(sql).fetchall()


def test_quality_rules_are_their_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, R.kept(docs).collect()), key=str)
    assert got == sorted(_duck(R.oracle_sql(), documents=docs), key=str)
    assert 0.5 * docs.count() < len(got) < docs.count()


def test_quality_rules_of_null_groups_blank_and_repeated_rows(spark):
    text = "plain words stand here in a row and end with a stop. "
    rows = [(k, text * (1 + k % 5), None if k % 2 else "en", "s" if k % 3 else None, 1) for k in range(120)]
    rows += [(200, "$$$ ### @@@ !!! %%% " * 30, "en", "s", 1), (201, None, "en", "s", 1), (202, "", "en", "s", 1), (203, " \n ", "en", "s", 1), (None, text, None, None, 1), (204, text * 4000, "en", "s", 1), (205, "again " * 300, None, "s", 1), (206, text, "xx", "rare", 1), (206, text, "xx", "rare", 1), (207, "LOUD " * 5 + "WORDS ARE HERE TO READ " * 40, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, words int")
    got = [r.doc_id for r in R.kept(docs).collect()]
    assert set(got) == set(range(120)) | {None, 204, 206}
    assert got.count(206) == 2
    assert R.kept(docs.limit(0)).count() == 0


def test_counts_are_those_of_brute_force():
    import unicodedata

    import numpy as np
    import pyarrow as pa

    texts = ["Plain text, 12 words words words", "", None, " \n\t ", "ÉTÉ été\nÉTÉ été\n\nx\nx \nx", "日本 ٣ 5\r\n5", "a\n" * 500, "end\n"]
    got = R.counts(pa.array(texts))
    for k, t in enumerate(texts):
        t = t or ""
        ink, w, lines = [c for c in t if c not in " \t\n\v\f\r"], t.split(), [x for x in t.split("\n") if x.split()]
        kind = [unicodedata.category(c) for c in ink]
        want = [sum(c[0] not in "LN" for c in kind), kind.count("Lu"), sum(c in "0123456789" for c in ink), sum(a == b for a, b in zip(w, w[1:])), len(lines) - len(set(lines)), len(ink), np.log(max(len(w), 1)), len(ink), len(w), len(lines), 1]
        assert np.allclose(got[k], want), t


def test_sketches_beyond_their_exact_size_are_near_the_quantiles(spark):
    import numpy as np
    from pyspark.sql import functions as F

    n = 3 * R.SKETCH_K
    rows = spark.range(n).select("id", F.lit("en").alias("lang"), F.lit("s").alias("source"), *(F.col("id").cast("double").alias(f"{r}_count") for r in R.RULES), *(F.lit(1.0).alias(u) for u in R._UNITS))
    got = R.thresholds(rows.repartition(5)).first()
    for r in R.RULES:
        assert abs(got[f"{r}_median"] - n / 2) < 0.005 * n
        assert abs(got[f"{r}_limit"] - (0.75 + 4 * 0.5) * n) < 0.05 * n and np.isfinite(got[f"{r}_floor"])


def test_lines_that_repeat_and_words_that_are_odd_break_rules(spark):
    text = "plain words stand here in a row and end with a stop.\nanother line follows it\nand a last one"
    rows = [(k, text + f"\nline {k}", "en", "s", 1) for k in range(60)]
    rows += [(100, "the same line\n" * 80, "en", "s", 1), (101, "x y z " * 100, "en", "s", 1), (102, "incomprehensibilities " * 3 + "counterrevolutionaries antidisestablishmentarianism " * 60, "en", "s", 1), (103, "007 11 42 " * 100, "en", "s", 1)]
    got = {r.doc_id for r in R.kept(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, words int")).collect()}
    assert got == set(range(60))


RULES = [(1, "a.com", "deny"), (2, "a.com/x", "allow"), (3, "a.com/x/y", "deny"), (4, "b.a.com", "allow"), (5, "c.org/p", "deny"), (6, "c.org/p", "allow"), (7, "c.org/p", "deny"), (8, None, "deny"), (9, "", "deny")]
URLS = ["http://a.com", "https://www.A.com/", "a.com/x?q=1", "http://u:p@a.com:80/x/y/z#f", "http://a.com/xy", "http://b.a.com/x", "http://d.b.a.com", "http://aa.com", "http://c.org/p/", "http://c.org/pp", "http://c.org", None, "", "   ", "/no/host", "http://a.com", "http://z.net/" + "deep/" * 3000]


def _brute(url):
    key = U_key(url)
    best = None
    for n, p, action in RULES:
        k = U_key(p)
        if key and k and key.startswith(k):
            rank = (len(k), action == "deny", -n)
            if best is None or rank > best[0]:
                best = (rank, n, action)
    return (best[1], best[2]) if best else (None, "allow")


def U_key(url):
    import re

    if not url or not url.strip():
        return None
    m = re.match(U._PARTS, url.strip())
    host = re.sub(r"^www\.|\.+$", "", m[1].lower())
    path = re.sub("/+$", "", m[2] or "")
    return ".".join(reversed(host.split("."))) + "." + (path + "/" if path else "") if host else None


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_url_rules_are_brute_force(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pages = spark.createDataFrame([(k if k != 3 else None, u, "x", 1) for k, u in enumerate(URLS)], "page_id long, url string, key string, kind int")
        rules = spark.createDataFrame(RULES, "rule_id long, pattern string, action string")
        got = sorted(map(tuple, U.judged(pages, rules).collect()), key=str)
        want = sorted(((k if k != 3 else None, u, *_brute(u)) for k, u in enumerate(URLS)), key=str)
        assert got == want
        assert U.judged(pages.limit(0), rules).count() == 0
        assert {r.action for r in U.judged(pages, rules.limit(0)).collect()} == {"allow"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_url_rules_are_their_sql(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = sorted(map(tuple, U.judged(pages, U.rule_table(spark)).collect()), key=str)
    assert got == sorted(_duck(U.oracle_sql(), pages=pages), key=str)
    assert {r[3] for r in got} == {"allow", "deny"}
