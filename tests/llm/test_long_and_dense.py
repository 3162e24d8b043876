"""Addresses and pages of any length, evasive addresses, many languages, dense clusters, and the bound on trusted texts."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import embeddings, languages, quality
from plumbline.llm.urls import host_of

HOSTS = {
    "http://bad.com/x": "bad.com", "http:\\\\bad.com/x": "bad.com", "http:/bad.com/": "bad.com", "https:bad.com": "bad.com", "http:////bad.com": "bad.com", "\\\\bad.com\\x": "bad.com", "http://ba\td.c\nom/": "bad.com",
    "http://b%61d.com/": "bad.com", "http://b%zzd.com/": "b%zzd.com", "http://good.org@bad.com/": "bad.com", "http://a@b@bad.com:80": "bad.com", "http://bad.com\\@good.org": "bad.com", "HTTP://BAD.COM...": "bad.com",
    "gopher://Bad.com:70/1": "bad.com", "mailto:x@bad.com": None, "javascript:alert(1)": None, "bad.com": "bad.com", "u@bad.com/x": "bad.com", "bad.com:80": "bad.com", "bad.com:http": None, "bad": None, ".": None, "": None, None: None,
    " \x01bad.com/ \x00": "bad.com", "http://[::1]:8/x": "[::1]", "http://" + "a." * 126 + "b": "a." * 126 + "b", "http://" + "a." * 130 + "b": None, "x" * 10 + " " * 10 + ".com": None, "http://a b.com": "a", "//bad.com?x@y": "bad.com", "http://": None, "http://b+d.com": "b+d.com", "http://%62+d.com": "b+d.com",
}


def test_hosts(spark):
    df = spark.createDataFrame([(u,) for u in HOSTS], "u string")
    assert {r.u: r.h for r in df.select("u", host_of(F.col("u")).alias("h")).collect()} == HOSTS


def test_long_addresses_and_pages_take_linear_time(spark):
    n = 1_000_000
    urls = ["a" * n, "a." * (n // 2), "@" * n, "a@" * (n // 2), ":" * n, "http://" + "%61" * (n // 3), "http:" + "/" * n, " " * n + "x", "a" + " " * n + "b", "http://[" + "[" * n, "h+" * (n // 2) + "://x"]
    pages = ["<script>" * (n // 8), "<" * n, "<!--" * (n // 4), "<html" * (n // 5), "</script " * (n // 9), "<script>" + "</script" * (n // 8), "&" * n, "<html" + " lang" * (n // 5), "<style" + " " * n]
    df = spark.createDataFrame([(u, "") for u in urls] + [("http://x.org", p) for p in pages], "url string, html string").repartition(8).cache()
    df.count()
    records = languages.page_records(df, [])
    records.limit(1).collect()
    began = time.time()
    got = records.select(F.length("text").alias("n"), "host", "declared").collect()
    assert time.time() - began < 30 and len(got) == len(urls) + len(pages)
    df.unpersist()


def test_unending_parts_of_pages(spark):
    cases = {"a<script>x": "a ", "a<script>x</script >b": "a b", "a<!-- b": "a ", "1 < 2 and 3": "1 < 2 and 3", "<p>a<b": " a<b", "a<STYLE>x</style>b<br/>c": "a b c", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "html string")
    assert {r.html: r.t for r in df.select("html", languages.html_text("html").alias("t")).collect()} == cases


def test_more_languages_than_are_known(spark, monkeypatch):
    rows = [(i, f"l{i % 7}", f"text number {i % 7} of some words") for i in range(70 - 3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert languages.train_languages(docs).languages == [f"l{i}" for i in range(7)]
    monkeypatch.setattr(languages, "MAX_LANGUAGES", 4)
    assert languages.train_languages(docs).languages == ["l0", "l1", "l2", "l3"]  # those with most documents


def test_dense_cluster(spark):
    rng = np.random.default_rng(1)
    near = rng.normal(size=64) + 0.02 * rng.normal(size=(8192, 64))
    began = time.time()
    forest, links, found = embeddings._Forest(len(near)), np.zeros(len(near), np.int64), 0
    for i, j in embeddings.near_pairs(near, near, 0.98):
        i, j = i[i < j], j[i < j]
        np.add.at(links, i, 1)
        np.add.at(links, j, 1)
        forest.add(i, j)
        found += len(i)
    assert time.time() - began < 40 and found == 8192 * 8191 // 2 and (links == 8191).all() and (forest.root == 0).all()


def test_near_pairs_and_forest_by_brute_force():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = np.concatenate([base + s * rng.normal(size=base.shape) for s in (0.0, 0.02, 0.06, 0.1)])
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    want = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if unit[i] @ unit[j] >= 0.98}
    forest, got = embeddings._Forest(len(rows)), set()
    for i, j in embeddings.near_pairs(rows, rows, 0.98):
        got |= set(zip(i.tolist(), j.tolist()))
        forest.add(i, j)
    assert got == want
    part = list(range(len(rows)))
    for _ in part:
        for i, j in want:
            part[i] = part[j] = min(part[i], part[j])
    assert forest.root.tolist() == part
    u, v = forest.links()
    assert len(u) == len(rows) - len(set(part)) and (v < u).all()


def test_trusted_texts_are_bounded(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(40)] + [(None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    ids = quality.trusted_ids(labels)
    kept, grams = quality.trusted_within(docs, ids)
    assert kept.count() == 30 and grams == 30 * 99
    few, grams = quality.trusted_within(docs, ids, 5 * 99)
    order = [r.doc_id for r in ids.collect()]
    assert grams == 5 * 99 and {r.doc_id for r in few.collect()} == set(order[:5])
    assert quality.table_size(10**9) == 10**8 and quality.table_size(0) == quality.BUCKETS
    some = quality.quality_signals(docs, labels, max_grams=1)
    assert some.where("log_ratio > 0").count() >= 1 and some.count() == 41
    assert quality.trusted_within(docs.limit(0), ids)[1] == 0
    with pytest.raises(TypeError):
        quality.table_size(docs, ids)
