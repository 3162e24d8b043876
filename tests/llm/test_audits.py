"""Filter audit, source divergence and exact dedup against brute force, with nulls, ties, repeats, hot groups and empty tables."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import divergence, exact, interactions, quotient

LONG = " ".join(f"v{i % 3001}" for i in range(30_000))
PROSE = " ".join(f"w{i}" for i in range(250))
TEXTS = [None, "", " ", "\t\n", "one", "One two", PROSE, f"{PROSE} $", f" {PROSE}", PROSE.replace(" ", "\n\t"), PROSE.upper(), LONG, "A B C | D", "word " * 300, "naïve École ÉCOLE 日本 😀 ß", "a\x0bb\x0cc\rd", "a b c d", "The the THE cat", "the Cat-cat_cat2cat", "x" * 40_000]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "hot" if i % 3 else None) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, t, "de" if i % 4 else "en", f"s{i % 3}") for i, t in enumerate(TEXTS)]
    rows += [(200 + i, TEXTS[17], "en", "hot") for i in range(40)]  # a hot group of copies
    rows += [(6, PROSE, "en", "hot"), (6, PROSE, "en", "hot"), (None, PROSE, None, None), (None, "alone", "en", "s1"), (None, None, "xx", "quiet"), (None, "twice without id", "en", "s1"), (None, "twice without id", "en", "s1")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return table.selectExpr("*", "1 as n", "2 as part", "'x' as mask", "3 as fp", "4 as sha", "5 as place", "6 as term", "7 as good", "8 as body", "9 as digest", "'y' as step").repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (6, 0, 1), (7, 1, 0), (10, 0, 1), (12, 1, 1), (110, 1, None), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")


# filter interaction audit


def audit(rows, marks):
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    out = defaultdict(Counter)
    shapley = Counter()
    for r in rows:
        text, part, w = r.text or "", r.source or "", words(r.text)
        bad = {k for k, failed in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), r.doc_id is not None and r.doc_id > least[text])) if failed}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, k in enumerate(order, 1):
                cell = out[part, order, step]
                fails = k in bad
                cell["removed"] += fails and not gone
                cell["redundant"] += fails and gone
                cell["unique_fails"] += bad == {k}
                cell["good_lost"] += fails and not gone and r.doc_id in good
                cell["toxic_lost"] += fails and not gone and r.doc_id in toxic
                shapley[part, k] += fails and not gone
                gone |= fails
                cell["kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(*key, *(c[x] for x in names), shapley[key[0], key[1][key[2] - 1]]) for key, c in out.items()}


def test_filter_audit(docs, labels):
    got = interactions.filter_interactions(docs, labels)
    assert dict(got.dtypes)["step"] == "int" and all(kind == "bigint" for name, kind in got.dtypes if name not in ("part", "filter_order", "step"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 600 * len({r.source or "" for r in docs.collect()}) == len(set(rows))
    assert set(rows) == audit(docs.collect(), labels.collect())


def test_filter_audit_of_nothing(docs, labels):
    assert interactions.filter_interactions(docs.limit(0), labels).count() == 0
    unlabelled = interactions.filter_interactions(docs, labels.limit(0))
    assert unlabelled.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_step_verdicts(spark):
    masks = spark.createDataFrame([(0,), (5,), (31,)], "mask int")
    got = {(r.mask, r.filter_order, r.step): (r.letter, r.fails, r.earlier) for r in interactions.step_verdicts(masks, "ABCDE").collect()}
    assert len(got) == 3 * 600
    assert [got[5, "CABDE", k] for k in range(1, 6)] == [("C", 4, 0), ("A", 1, 4), ("B", 0, 5), ("D", 0, 5), ("E", 0, 5)]
    assert all(got[0, o, s][1:] == (0, 0) for _, o, s in got)


# source divergence


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def diverge(rows, min_docs, top):
    count, docs_of, groups = Counter(), Counter(), set()
    for r in rows:
        lang, source, t = r.lang or "", r.source or "", terms_of(r.text)
        groups.add((lang, source))
        count.update((lang, source, x) for x in t)
        docs_of.update((lang, x) for x in set(t))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (g, t), d in docs_of.items() if g == lang and d >= min_docs)
        sources = sorted(s for g, s in groups if g == lang)
        scaled = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: B023, E731
        prob = {s: {t: scaled(count[lang, s, t], sum(count[lang, s, x] for x in kept)) for t in kept} for s in sources}
        both = {t: sum(count[lang, s, t] for s in sources) for t in kept}
        whole = {t: scaled(both[t], sum(both.values())) for t in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pairs = [(o, sum(f(prob[s][t], prob[o][t]) for t in kept)) for o in sources if o != s]
            found = [(t, f(prob[s][t], whole[t])) for t in kept if count[lang, s, t] and prob[s][t] > whole[t]]
            for part, items in (("pair", pairs), ("term", found)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return out


@pytest.mark.parametrize(("min_docs", "top"), [(3, 200), (1, 7), (10_000, 5)])
def test_source_divergence(docs, min_docs, top):
    got = divergence.source_divergence(docs, min_docs, top)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(map(tuple, got.collect())) == sorted(diverge(docs.collect(), min_docs, top))


def test_source_divergence_of_nothing(docs, spark):
    assert divergence.source_divergence(docs.limit(0)).count() == 0
    quiet = spark.createDataFrame([("en", "a", None), ("en", "b", "12 34")], "lang string, source string, text string")
    assert sorted(map(tuple, divergence.source_divergence(quiet).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_probability_is_exact(spark):
    big = 10**17
    got = spark.createDataFrame([(big - 1, big, 7), (0, 0, 1), (big, 9 * big, 0)], "c long, n long, v long").select(divergence.probability(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * big // (big + 7), 1 + 10**9, 1 + 10**9 * (big + 1) // (9 * big)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aZ é日\t-\x7f0", max_size=12), max_size=8))
def test_split_terms(texts):
    import pyarrow as pa

    row, terms = divergence.split_terms(pa.array(["skipped", *texts], pa.string()).slice(1))
    assert list(zip(row.tolist(), terms.to_pylist())) == [(i, t) for i, text in enumerate(texts) for t in terms_of(text)]


# exact dedup


def duplicates(rows):
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r.text)].append(r.doc_id)
    out = []
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        digest = hashlib.sha256(body.encode()).hexdigest()
        out += [(i, keep, len(ids), k == ids.index(keep), digest) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def test_exact_duplicates(docs):
    got = exact.exact_duplicates(docs)
    assert [kind for _, kind in got.dtypes] == ["bigint", "bigint", "bigint", "boolean", "string"]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == duplicates(docs.collect())
    assert sum(r[3] for r in rows) == len({r[4] for r in rows})
    assert exact.exact_duplicates(docs.limit(0)).count() == 0


def test_routing_sends_every_repeated_fingerprint(spark):
    ids = [1, 1, 2, 3, -5, -5, -5, 2**63 - 1, -(2**63), -(2**63)]
    prints = spark.createDataFrame([(i,) for i in ids], "fp long").repartition(4)
    for bits in (6, 9):
        merged = exact.fingerprint_counts(prints, bits)
        found = {}
        for r in merged.collect():
            fps, n = quotient.decode(r["filter"], r["segment"])
            found |= dict(zip(fps.view(np.int64).tolist(), n.tolist()))
        assert found == Counter(ids)
        sent = {r.fp for r in exact.routed(prints, exact.route_bitmap(merged, bits, 16), 16).collect()}
        assert {1, -5, -(2**63)} <= sent and 2**63 - 1 not in sent


def test_colliding_fingerprints_are_told_apart_by_bytes(docs, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    assert sorted(map(tuple, exact.exact_duplicates(docs).collect()), key=repr) == duplicates(docs.collect())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40), max_size=60), min_size=1, max_size=5), st.sampled_from([0, 1, 6, 20]))
def test_filters_merge_without_loss(parts, bits):
    by_segment = defaultdict(list)
    for part in parts:
        for segment, data in quotient.split(*quotient.tally(np.array(part, np.uint64)), bits):
            by_segment[segment].append(data)
    found = {}
    for segment, filters in by_segment.items():
        prints, counts = quotient.merge(filters, segment)
        assert (np.diff(prints.astype(object)) > 0).all()
        again = quotient.decode(quotient.encode(prints, counts, bits), segment)
        assert again[0].tolist() == prints.tolist() and again[1].tolist() == counts.tolist()
        found |= dict(zip(prints.tolist(), counts.tolist()))
    assert found == Counter(x for part in parts for x in part)
