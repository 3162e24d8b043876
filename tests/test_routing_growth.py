"""Keyword tables: texts are read once, however many keywords there are, and nothing is lost at a chunk's or a text's border."""

import numpy as np
import pyarrow as pa

from plumbline.operators import routing


def test_texts_are_read_once_for_any_number_of_keywords(spark):
    rng = np.random.default_rng(5)
    letters = list("abcdeé")
    table = [("AB"[i % 2], "".join(rng.choice(letters, rng.integers(2, 6)))) for i in range(300)] + [("A", "edcb"), ("B", "edcb")]
    long = "".join(rng.choice(letters, 3000))
    texts = [None, "", "abc", "ab", long, "É" + long[:50].upper(), *("".join(rng.choice([*letters, "E", " ", "\n", "1", "日"], 60)) for _ in range(60))]
    sets = {d: {w for k, w in table if k == d} for d in "AB"}
    want = {i: {d: sum(w in (t or "").lower() for w in ws) / len(ws) for d, ws in sets.items()} for i, t in enumerate(texts)}
    got = routing.classify_by_table(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", spark.createDataFrame(table, "domain string, keyword string"), block=10)
    assert {r.id: {s.domain: s.score for s in r.all_scores} for r in got.collect()} == {i: {d: s for d, s in w.items() if s} for i, w in want.items()}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_chunks_of_texts_keep_order_and_bounds():
    texts = ["a" * n for n in (3, 0, 50, 4, 4, 4, 0, 9)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, j), pa.int64()), pa.array(texts[i:j], pa.string())], ["place", "low"]) for i, j in ((0, 3), (3, 3), (3, 8))]
    got = [t.to_pydict() for t in routing._chunks(iter(batches), 10)]
    assert [p for t in got for p in t["place"]] == list(range(8)) and [x for t in got for x in t["low"]] == texts
    assert all(len(t["low"]) == 1 or sum(map(len, t["low"])) <= 10 for t in got)
