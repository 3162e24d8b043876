"""The pipeline against the brute-force operators, stage by stage."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import packing
from plumbline.llm.vocabulary import offset_tokenizer
from plumbline.scratch import release
from test_corpus_operators import AWKWARD, DOC, PASSAGE, SF, base_signals, brute_components, brute_cut, brute_fingerprint


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, rules), (_, lang), (_, near), (_, cut), (_, pack) = corpus_pipeline.STAGES
    kept = rules(spark, docs, SF)
    kept.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/t1")
    kept = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/t1")
    assert kept.columns == docs.columns
    assert all(not base_signals(r.text)[-1] for r in kept.collect()) and kept.count() > 0.7 * docs.count()
    told = lang(spark, kept, SF)
    assert told.columns == docs.columns and told.count() > 0.95 * kept.count()
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in told.collect()]
    want = {d for (d, _), c in zip(rows, brute_components(rows)) if d == c}
    one = near(spark, told, SF)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == want
    brute = {d: (n, gone, text) for d, n, gone, text in brute_cut([(r.doc_id, r.text) for r in one.collect()], 50)}
    left = cut(spark, one, SF)
    assert left.columns == docs.columns
    texts = {r.doc_id: r for r in left.collect()}
    assert set(texts) == {d for d, (n, gone, _) in brute.items() if gone < n}
    assert all(r.text == brute[d][2] for d, r in texts.items() if brute[d][1]) and all(len(r.text) == r.n_chars for r in texts.values())
    placed = pack(spark, left, SF).collect()
    tokenizer = offset_tokenizer()
    sizes = {d: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in texts.items()}
    assert sorted((r.doc_id, r.start, r.length) for r in placed) == sorted((d, *p) for d, n in sizes.items() for p in packing.pieces_of(n, 2048))
    assert len({r.sequence_id for r in placed}) <= 1.02 * -(-sum(sizes.values()) // 2048) + 1


def test_run_is_the_stages(spark):
    with ThreadPoolExecutor(2) as pool:  # two pipelines beside each other do not touch each other's tables
        one, two = pool.map(lambda _: corpus_pipeline.run(spark, SF), range(2))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(one.columns) and one.count() > 0
    assert np.all([r.length <= 2048 for r in one.collect()])
    own = [c for c in one.columns if c not in ("sequence_id", "offset")]
    assert one.select(own).exceptAll(two.select(own)).isEmpty() and one.select("sequence_id").distinct().count() == two.select("sequence_id").distinct().count()
    release(one, two)
    with pytest.raises(Exception, match="(?i)does not exist"):
        one.collect()


def test_stages_take_awkward_rows_and_no_rows(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    good = [tuple(r) for r in table.orderBy("doc_id").limit(60).collect()]
    odd = [(1000 + i, t, None, None, None) for i, t in enumerate(AWKWARD)] + [(None, PASSAGE, None, None, None), (None, None, None, None, None)]
    rows = good + good[:20] + odd + [(None, *good[-1][1:]), (good[3][0], good[4][1], "en", None, 1)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as kept", "'x' as host", "2 as length", "3 as text_key", "4 as component_id")
    folder = spark.conf.get("spark.checkpoint.dir")
    for name, source in (("odd", docs), ("none", docs.limit(0))):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, source, SF)
            got.write.mode("overwrite").parquet(f"{folder}/{name}{i}")
            source = spark.read.schema(got.schema).parquet(f"{folder}/{name}{i}")
            if i < 4:
                assert source.columns == corpus_pipeline.COLUMNS
            if i == 2 and name == "odd":
                kept = [(r.doc_id, brute_fingerprint(r.text)) for r in source.collect()]
                assert len(kept) == len({f for _, f in kept}) and all((a ^ b).bit_count() > 2 for j, (_, a) in enumerate(kept) for _, b in kept[:j])
        assert (source.count() > 0) == (name == "odd")
