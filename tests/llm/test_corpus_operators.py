"""Each operator against brute force, with nulls, empty and very long texts, ties, repeats and empty tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import binary, catalog, chat, embeddings, languages, packing, pieces, quality, simhash, substrings, urls
from plumbline.llm.components import connected_components
from plumbline.llm.vocabulary import file_path, offset_tokenizer

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"w{i}" for i in range(70))
LONG = " ".join(f"v{i % 3001}" for i in range(30_000))
AWKWARD = [None, "", "   ", "one", "one two", "one two three", PASSAGE, f"start {PASSAGE} end", PASSAGE + " tail", LONG, "a\tb\x0bc\n\nd  e", "naïve ▁ mark <|endoftext|> \0 日本 😀", "#$% ||| ***", "UPPER upper Upper", "x" * 5000]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "hot" if i % 3 else "s", 1) for i, t in enumerate(AWKWARD)]
    rows += [(100 + i, t, "de", None, None) for i, t in enumerate(AWKWARD)]  # copies
    rows += [(3, "one", "en", "hot", 3), (None, PASSAGE, None, None, None), (None, None, None, None, None)]
    extra = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as text_key", "2 as anchor", "3 as length", "'x' as kept_text", "true as good", "4 as grams", "5 as m0", "6 as fp", "7 as ids", "8 as Kept", "9 as start", "10 as sequence_id")
    return extra.repartition(3)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def none_of(df):
    return df.limit(0)


def as_key(rows):
    return sorted(rows, key=repr)


# quality rules


def base_signals(text):
    w = words(text)
    seen = defaultdict(int)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])] += 1
    hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def test_quality_signals(spark, docs, table):
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (7, 1, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for source in (docs, table):
        got = quality.quality_signals(source, labels).collect()
        texts = defaultdict(list)
        for r in source.collect():
            texts[r.doc_id].append(base_signals(r.text))
        mine = defaultdict(list)
        for r in got:
            mine[r.doc_id].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
            assert not (r.kept and r.base_failed)
            assert r.base_failed or r.kept == (r.log_ratio >= quality.THRESHOLD)
        assert {k: as_key(v) for k, v in mine.items()} == {k: as_key(v) for k, v in texts.items()}
    assert quality.quality_signals(none_of(docs), labels).count() == 0
    alone = quality.quality_signals(docs, none_of(labels)).select("log_ratio").distinct().collect()
    assert [r[0] for r in alone] == [0.0]


def test_quality_ratio_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c c")], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,)], "doc_id long")
    counts = quality.ngram_counts(docs, trusted, 1 << 12)
    assert counts.sum(axis=1).tolist() == [5 + 3, 3 + 2]
    weights = quality.log_ratio(counts, 1e-9)
    a = xxhash.xxh3_64_intdigest("a") % (1 << 12)
    assert weights[a] == pytest.approx(np.log((2 / 5) / (2 / 8)), abs=0.01)


def test_quality_ratio_brute_force(docs, table, spark):
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (7, 1, 0), (9, 0, 0), (None, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    mask = (1 << 64) - 1

    def mix(x):
        for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ x >> 33) * k) & mask
        return x ^ x >> 33

    def grams(text, buckets):
        h = [xxhash.xxh3_64_intdigest(w) for w in words(text)]
        return [x % buckets for x in [*h, *(mix((a * 0x9E3779B97F4A7C15 + b) & mask) for a, b in zip(h, h[1:]))]]

    for source, buckets in ((docs, 1000), (table, quality.BUCKETS)):
        rows = source.collect()
        raw, good = np.zeros(buckets), np.zeros(buckets)
        for r in rows:
            np.add.at(raw, grams(r.text, buckets), 1)
            if r.doc_id in (6, 7):
                np.add.at(good, grams(r.text, buckets), 1)
        weights = np.log((good + 1) / (raw * good.sum() / raw.sum() + 1))
        want = []
        for r in rows:
            at = grams(r.text, buckets)
            score = round(float(weights[at].mean()) if at else 0.0, 6)
            want.append((r.doc_id, score, not base_signals(r.text)[-1] and score >= quality.THRESHOLD))
        got = quality.quality_signals(source, labels, buckets=None if source is table else buckets).select("doc_id", F.round("log_ratio", 6), "kept").collect()
        assert as_key(map(tuple, got)) == as_key(want)


def test_quality_keeps_good_and_drops_junk(spark):
    d, sf = "doc_id", "/root/testdata/sf0.01"
    got = catalog.op1_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), d).where("n_words >= 10")
    good, bad = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("kept").count() >= 0.98 * good.count()
    assert bad.where("kept").count() <= 0.35 * bad.count()


def test_quality_drops_junk_at_every_size(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        got = catalog.op1_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
        good, bad = (got.where(f"quality = {k}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for k in (1, 0))
        assert good >= 0.98 and bad <= 0.05, sf


# SentencePiece


def test_pieces_match_the_library(docs, table):
    import sentencepiece

    path = file_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(5)
    odd = ["".join(rng.choice(list(" ▁  aethion.\n0<>日é😀\t"), rng.integers(1, 60))) for _ in range(400)]
    model = pieces.load_model(path)
    import pyarrow as pa

    offsets, ids = model.encode(pa.array(odd))
    for k, text in enumerate(odd):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == lib.encode(text), text
    for source in (docs, table):
        for r in pieces.decode_pieces(pieces.encode_pieces(source)).collect():
            assert r.ids == lib.encode(r.text or "")
            assert r.decoded == (r.text or "").replace("▁", " ")
    assert pieces.encode_pieces(none_of(docs)).count() == 0
    clash = pieces.decode_pieces(pieces.encode_pieces(docs).selectExpr("*", "1 as Decoded"))
    assert clash.columns == ["doc_id", "text", "ids", "decoded"] and clash.where("decoded is null").count() == 0


def test_unigram_pieces_are_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(60):
        names = {"".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(14)} | {pieces.MARK, "a", "b"}
        vocab = {p: (i + 1, float(-rng.integers(1, 90))) for i, p in enumerate(sorted(names))}
        model = pieces.PieceModel(vocab, {}, 0, True)
        for _ in range(20):
            word = pieces.MARK + "".join(rng.choice(list("abcz"), rng.integers(0, 9)))
            best = {0: 0.0}
            for j in range(1, len(word) + 1):
                ways = [best[i] + vocab[word[i:j]][1] for i in range(j) if word[i:j] in vocab]
                best[j] = max([*ways, *([] if word[j - 1] in vocab else [best[j - 1] + model.floor])])
            model.learn([word])
            score = {i: s for _, (i, s) in vocab.items()} | {0: model.floor}
            assert sum(score[i] for i in np.frombuffer(model.known[word], "<i4").tolist()) == pytest.approx(best[len(word)])


# substring dedup


def brute_cut(rows, window):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = {j for i in range(len(w) - window + 1) if doc is not None and first[tuple(w[i : i + window])] < doc for j in range(i, i + window)}
        out.append((doc, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return as_key(out)


def test_substrings_brute_force(spark, docs, table):
    rng = np.random.default_rng(11)
    base = [rng.integers(0, 4, 40) for _ in range(6)]
    noisy = []
    for i in range(60):
        parts = [base[k][rng.integers(0, 20) : rng.integers(20, 41)] for k in rng.integers(0, 6, 4)]
        noisy.append((int(rng.integers(0, 50)), " ".join(f"t{x}" for p in parts for x in [*p, rng.integers(0, 9)])))
    small = spark.createDataFrame(noisy, "doc_id long, text string").repartition(5)
    for source, window, gram in ((docs, 50, 12), (table, 50, 12), (small, 12, 4), (small, 9, 9)):
        got = substrings.remove_repeats(source, window, gram).collect()
        assert as_key([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got]) == brute_cut([(r.doc_id, r.text) for r in source.collect()], window)
        texts = defaultdict(list)
        for r in source.collect():
            texts[r.doc_id].append(words(r.text))
        for r in got:
            assert sum(f.end - f.start for f in r.factors) == r.n_removed and all(a.end <= b.start for a, b in zip(r.factors, r.factors[1:]))
            w = words(r.text)
            for f in r.factors:  # each factor is what its reference holds, word for word
                assert f.ref_doc < r.doc_id and any(t[f.ref_start : f.ref_start + f.end - f.start] == w[f.start : f.end] for t in texts[f.ref_doc])
    assert substrings.remove_repeats(none_of(docs)).count() == 0


def test_parse_is_greedy():
    runs = [np.array(x) for x in zip((0, 3, 60, 7, 0), (0, 10, 70, 8, 5), (0, 65, 130, 9, 1), (0, 200, 255, 7, 0), (2, 0, 50, 4, 9))]
    assert substrings.parse(runs) == [(0, 3, 60, 7, 0), (0, 60, 70, 8, 55), (0, 70, 130, 9, 6), (0, 200, 255, 7, 0), (2, 0, 50, 4, 9)]


# SimHash


def brute_fingerprint(text):
    w = words("".join(c.lower() if c < "\x80" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items):
    """items: (id, fingerprint) -> smallest id reachable, in order."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(items):
        if doc is not None:
            least[find(i)].append(doc)
    return [min(least[find(i)], default=None) for i in range(len(items))]


def test_simhash_brute_force(docs, table):
    for source in (docs, table):
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in source.collect()]
        want = as_key([(d, f"{fp:016x}", c) for (d, fp), c in zip(rows, brute_components(rows))])
        got = simhash.simhash_components(source).select("doc_id", simhash.hex_digits(), "component_id").collect()
        assert as_key(map(tuple, got)) == want
    assert simhash.simhash_components(none_of(docs)).count() == 0


def test_fingerprint_links_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 100)
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2**64, 5, dtype=np.uint64)
    fps = {int(s) for s in seeds} | {0, 1, 3, 7, 2**64 - 1}
    for s in seeds:
        for _ in range(40):
            x = int(s)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= {int(x) << 48 | 12345 for x in rng.integers(0, 1 << 16, 3000)}  # one crowded list
    items = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in items]
    edges = simhash.link_fingerprints(spark.createDataFrame(signed, "fp long"))
    assert edges.count() <= 28 * len(items)
    got = {r.node % 2**64: r.component for r in connected_components(edges).collect()}
    names = brute_components([(i, f) for i, f in enumerate(items)])
    groups = defaultdict(set)
    for f, c in zip(items, names):
        groups[c].add(f)
    own = lambda f: got.get(f, f - (1 << 64) if f >> 63 else f)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in _by(items, own).values())


def _by(items, key):
    out = defaultdict(list)
    for x in items:
        out[key(x)].append(x)
    return out


def test_simhash_rows_without_ids_and_with_one_id(spark, docs, monkeypatch):
    # fingerprints 0, 3 and 15: the two ends reach each other over a row without an id
    rows = [(7, 0), (None, 3), (9, 15), (None, 7 << 40), (None, (7 << 40) + 1), (4, -1), (4, -1), (4, -2), (None, -(2**63) + (7 << 20))]
    rows += [(5, 0xFF << 30), (5, 1 << 20), (3, (1 << 20) + 1)]  # id 5 twice: one row links to 3, the other to none
    fake = spark.createDataFrame([(d, i if d is None else d, f) for i, (d, f) in enumerate(rows)], "doc_id long, text_key long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: fake)
    got = simhash.simhash_components(docs).collect()
    want = brute_components([(d, f % 2**64) for d, f in rows])
    assert want[:9] == [7, 7, 7, None, None, 4, 4, 4, None] and want[9:] == [5, 3, 3] or want[9] == 5
    assert as_key((r.doc_id, r.fp, r.component_id) for r in got) == as_key((d, f, c) for (d, f), c in zip(rows, want))


def test_simhash_representatives(docs, table):
    for source in (docs, table):
        rows = [(r.doc_id, brute_fingerprint(r.text), r.text) for r in source.collect()]
        parts = brute_components([(d, fp) for d, fp, _ in rows])
        got = simhash.keep_representatives(source)
        assert got.columns == source.columns
        kept = [(r.doc_id, r.text) for r in got.collect()]
        assert sorted(d for d, _ in kept) == sorted(set(parts)) and set(kept) <= {(d, t) for d, _, t in rows}
    twice = docs.unionByName(docs)
    assert as_key(map(tuple, simhash.keep_representatives(twice).collect())) == as_key(map(tuple, simhash.keep_representatives(docs).collect()))
    nameless = docs.selectExpr("cast(null as long) as doc_id", "text")
    kept = [r.text for r in simhash.keep_representatives(nameless).collect()]
    fps = [brute_fingerprint(t) for t in kept]
    groups = brute_components([(i, brute_fingerprint(r.text)) for i, r in enumerate(docs.collect())])
    assert len(kept) == len(set(groups)) and all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])
    assert simhash.keep_representatives(none_of(docs)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(300)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# embeddings


def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for label in (0, 1, None):
        centres = rng.normal(size=(5, 16))
        for _ in range(60):
            v = centres[rng.integers(0, 5)] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.2])
            rows.append((len(rows), [float(np.float32(x)) for x in v], label))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [], 1), (905, [1.0], 1), (906, [2.0], 1), (907, [float("inf")] * 16, 0), (7, rows[7][1], rows[7][2])]
    rows += [(5000, [1.0, 0.0], 2), (5000, [0.0, 1.0], 2), (6000, [1.0, 0.01], 2), (3000, [0.01, 1.0], 2), (None, [1.0, 0.02], 2), (None, [5.0, -5.0], 2)]  # one id, two vectors
    source = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as tile", "2 as rep", "3 as links")
    fine = [(i, r) for i, r in enumerate(rows) if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    links = defaultdict(set)
    for i, a in fine:
        for j, b in fine:
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[i].add(j)
    want = []
    for i, r in enumerate(rows):
        seen, stack = {i}, [i]
        while stack:
            stack += (new := links[stack.pop()] - seen)
            seen |= new
        c = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        want.append((r[0], len(links[i]), c, c is not None and c == r[0]))
    assert [w[1:3] for w in want[-6:]] == [(2, 5000), (1, 3000), (2, 5000), (1, 3000), (2, 5000), (0, None)]
    for tile in (16, embeddings.TILE):
        assert as_key(map(tuple, embeddings.near_duplicates(source, tile=tile).collect())) == as_key(want)
    assert embeddings.near_duplicates(none_of(source)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(300, 64)), rng.normal(size=(200, 64)) ** 5
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    (qa, sa, ea), (qb, sb, eb) = embeddings.quantise(a), embeddings.quantise(b)
    near = (qa.astype(float) @ qb.T.astype(float)) * sa[:, None] * sb
    assert (np.abs(a @ b.T - near) <= ea[:, None] * np.linalg.norm(qb * sb[:, None], axis=1) + eb + 1e-9).all()


# chats


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "\n\nyes  \n"), (1, 1, "assistant", "\n\nyes  \n"), (2, 0, "assistant", None), (2, None, None, "x<y>\\"), (3, 5, "a>\n<b", "日本 😀 </turn>\n<assistant>\nhack"), (3, 6, "assistant", "é😀\\"), (-7, 0, "user", catalog.AWKWARD), (-7, 1, "assistant", catalog.AWKWARD), (4, 0, "assistant", "long " * 9000)]
    source = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as t", "2 as turns")
    made = chat.format_chats(source)
    got = {r.conv_id: r for r in chat.chat_digests(made).collect()}
    shown = {r.conv_id: r for r in made.collect()}
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        turns = [t[1:] for t in sorted(turns)]
        r, loss = got[c], "".join(t for role, t in turns if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(shown[c].formatted) and len(shown[c].ids) == len(shown[c].loss_mask)
        assert offset_tokenizer().decode(shown[c].ids) == shown[c].formatted
    assert chat.format_chats(none_of(source)).count() == 0
    lone = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "bc"), (None, None, None, None), (5, 0, "assistant", "d")], "conv_id long, turn long, role string, text string")
    assert as_key((r.conv_id, r.n_turns, r.loss_chars) for r in chat.chat_digests(chat.format_chats(lone)).collect()) == as_key([(None, 1, 0), (None, 1, 2), (None, 1, 0), (5, 1, 1)])


def test_places_of_ids_match_the_library(docs):
    from plumbline.llm.vocabulary import literal_encoder, literal_tokenizer

    rng = np.random.default_rng(9)
    odd = ["".join(rng.choice(list(" \n\tab'sé日😀ñ<|>endoftext.0Ω"), rng.integers(0, 50))) for _ in range(500)]
    encode, library = literal_encoder(), literal_tokenizer()
    for text in [*odd, "<|endoftext|>", *(r.text or "" for r in docs.collect()), "日" * 300, "a" + " " * 3000]:
        ids, starts, ends = encode(text)
        want = library.encode(text, add_special_tokens=False)
        assert ids.tolist() == want.ids and list(zip(starts.tolist(), ends.tolist())) == want.offsets, text[:60]


# languages


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = languages.train_languages(docs.where("doc_id % 2 = 0"))
    none = F.lit(None).cast("string")
    held = docs.where("doc_id % 2 = 1").select("doc_id", "lang", "text", none.alias("host"), none.alias("suffix"), none.alias("declared"))
    got = languages.identify(held.withColumnRenamed("lang", "truth"), model, ["doc_id", "truth"]).where("lang <> 'und'")
    assert got.where("lang = truth").count() >= 0.97 * got.count()
    assert got.where("kept").count() >= 0.98 * got.count()


def test_languages_awkward(spark, docs, table):
    model = languages.train_languages(table)
    rows = docs.select("doc_id", "text", F.col("source").alias("host"), F.lit("net").alias("suffix"), F.lit("de-AT").alias("declared"))
    got = languages.identify(rows, model, ["doc_id"]).collect()
    assert len(got) == docs.count()
    blank = [r for r in got if r.doc_id in (0, 1, 2)]
    assert all(r.lang == "und" and not r.kept and r.posterior is None for r in blank) and len(blank) == 3
    some = " ".join(words(next(r.text for r in table.collect() if r.lang == "en" and len(words(r.text)) > 9))[:2])
    short = spark.createDataFrame([(1, some, "h", "de"), (2, some, "h", "fr"), (3, some, "h", None)], "doc_id long, text string, host string, declared string").withColumn("suffix", F.lit(None).cast("string"))
    said = {r.doc_id: r for r in languages.identify(short, model, ["doc_id"]).collect()}
    assert said[1].posterior != said[2].posterior
    assert languages.identify(none_of(rows), model, ["doc_id"]).count() == 0
    untaught = languages.identify(rows, languages.train_languages(none_of(table)), ["doc_id"]).collect()
    assert {r.lang for r in untaught} == {"und"} and len(untaught) == len(got)


def test_language_evidence_by_hand(spark):
    model = languages.LanguageModel(["a", "b"], np.log(np.full((2, languages.BUCKETS), 1 / languages.BUCKETS)))
    rows = spark.createDataFrame([(1, "same", "h1", "x", "b"), (2, "same", "h2", "x", None)], "doc_id long, text string, host string, suffix string, declared string")
    got = {r.doc_id: r for r in languages.identify(rows, model, ["doc_id"], host_weight=2.0, suffix_weight=3.0).collect()}
    whole = 3 / 4  # both texts tie and count for "a"; one pseudo-count each
    suffix = (2 + 3 * whole) / 5
    host = (1 + 2 * suffix) / 3
    odds = host / (1 - host) * (0.1 / 0.9)
    assert got[2].posterior == pytest.approx(host) and got[2].lang == "a"
    assert got[1].posterior == pytest.approx(max(odds, 1) / (1 + odds))


def plain_grams(text):
    """Hashed 3-grams by definition, from the letters and marks of a text."""
    import regex

    body = " ".join(regex.findall(r"[\p{L}\p{M}]+", (text or "").lower()))
    data = f" {body} ".encode() if body else b""
    return [((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 16 for a, b, c in zip(data, data[1:], data[2:])]


def plain_languages(records, model, host_weight=20.0, suffix_weight=50.0, honest=0.9):
    """(key, lang, posterior, text_lang, kept) straight from the formula."""
    n, told, hosts, suffixes, whole = len(model.languages), [], defaultdict(lambda: np.zeros(10)), defaultdict(lambda: np.zeros(10)), np.ones(10)
    for key, text, host, suffix, declared in records:
        g, host, suffix = plain_grams(text), (host or "").lower(), (suffix or "").lower()
        mean = np.array([np.mean(model.logs[k][g]) if g else 0.0 for k in range(n)])
        first = int(np.argmax(mean)) if len(g) >= languages.MIN_GRAMS and mean.max() >= languages.NO_LANGUAGE - 1e-9 else None
        if first is not None:
            for t in (hosts[host, suffix], suffixes[suffix], whole):
                t[first] += 1
        told.append((key, len(g), mean, first, host, suffix, (declared or "").lower().split("-")[0]))
    out = []
    for key, grams, mean, first, host, suffix, said in told:
        if first is None:
            out.append((key, "und", None, "und", False))
            continue
        up = whole[:n] / whole[:n].sum()
        for counts, weight in ((suffixes[suffix][:n], suffix_weight), (hosts[host, suffix][:n], host_weight)):
            up = (counts + weight * up) / (counts.sum() + weight)
        markup = np.array([honest if x == said else (1 - honest) / (n - 1) for x in model.languages]) if said in model.languages else np.ones(n)
        logs = np.log(up) + np.log(markup) + mean * min(grams, languages.MAX_EVIDENCE)
        post = np.exp(logs - logs.max())
        post /= post.sum()
        best = int(np.argmax(logs))
        out.append((key, model.languages[best], round(float(post[best]), 6), model.languages[first], bool(post[best] >= 0.5)))
    return out


def test_languages_brute_force(spark, docs, table):
    model = languages.train_languages(table)
    raw = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    raw += [(None, None, None), (-1, "HTTP://u@Ab.Example.DE.:80/x", "<HTML class=x lang='de-AT'><script>var x = '<p>';</script><!-- no --><p>Der&nbsp;Hund</p><style>a{}</style></html>"), (-2, "x.fr/y", "<html lang=fr>le chien\net le chat"), (-3, "http://h", "Привет мир и всем добрый день")]
    raw += raw[:3]
    pages = spark.createDataFrame(raw, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as first")

    def fields(page):
        key, url, html = page
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html or "")
        m = re.match(r"(?i)\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", url or "") or re.match(r"([^/]+\.[^/]+)", url or "")
        host = m[1].lower().rstrip(".") if m else None
        said = re.search(r"(?i)<html[^>]*\blang\s*=\s*[\"']?([^\"'\s>]*)", html or "")
        return key, re.sub(r"&#?\w{1,8};", " ", text), host, host and host.rsplit(".", 1)[-1], said and said[1]

    made = languages.page_records(pages, ["page_id"])
    got = languages.identify(made, model, ["page_id"]).select("page_id", "lang", F.round("posterior", 6), "text_lang", "kept").collect()
    assert as_key(map(tuple, got)) == as_key(plain_languages(map(fields, raw), model))
    assert {r.lang for r in got if r.page_id == -3} == {"und"}
    rows = docs.select("doc_id", "text", F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"), "lang").withColumnRenamed("lang", "declared").withColumn("m0", F.col("doc_id"))
    got = languages.identify(rows, model, ["doc_id", "m0"]).select("doc_id", "lang", F.round("posterior", 6), "text_lang", "kept").collect()
    assert as_key(map(tuple, got)) == as_key(plain_languages([(r.doc_id, r.text, r.host, None, r.declared) for r in rows.collect()], model))


def test_rare_languages_are_known(spark):
    rows = [(i, "en", "the cat and the dog") for i in range(500)] + [(1000, "fi", "kissa ja koira juoksevat metsassa")]
    model = languages.train_languages(spark.createDataFrame(rows, "doc_id long, lang string, text string"), max_docs=20)
    assert model.languages == ["en", "fi"]


# packing


def test_placements(spark, docs, table):
    tokenizer = offset_tokenizer()
    for source in (docs, table):
        coded = packing.encode_pieces(source)
        got = packing.best_fit_placements(coded.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc"))).collect()
        want, total = [], 0
        for r in source.collect():
            ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
            total += len(ids)
            cuts = packing.pieces_of(len(ids), 2048)
            assert [s for s, _ in cuts] == [0, *np.cumsum([n for _, n in cuts])[:-1]] and all(n == 2048 for _, n in cuts[1:])
            want += [(r.doc_id, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(cuts)]
        assert as_key([(r.doc_id, r.piece, r.start, r.length, r.crc) for r in got]) == as_key(want)
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for items in bins.values():
            at = 0
            for offset, n in sorted(items):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(bins) <= 1.02 * -(-total // 2048) + 1
    assert packing.best_fit_placements(none_of(packing.encode_pieces(docs)).drop("ids")).count() == 0
    clash = spark.range(50).selectExpr("id as doc_id", "1 as piece", "id + 1 as length", "7 as salt", "8 as _salt", "'x' as Size", "9 as Sequence_ID", "10 as offset", "11 as base", "12 as rank", "13 as n")
    got = packing.best_fit_placements(clash)
    assert got.columns == ["doc_id", "piece", "length", "salt", "_salt", "Size", "base", "rank", "n", "sequence_id", "offset"]
    assert as_key(map(tuple, got.drop("sequence_id", "offset").collect())) == as_key(map(tuple, clash.drop("Sequence_ID", "offset").collect()))
    with pytest.raises(ValueError):
        packing.best_fit_placements(spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long"), 8)


def test_added_tokens_get_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext> |>", "<|endoftext|>" + " " * 5000 + "z"]
    got = packing.encode_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1 << 20).collect()
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got}
    assert ids == {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)} and ids[0] == [64, 220, 50256, 275, 0]
    alone = spark.createDataFrame([(1, 0, "user", texts[0]), (1, 1, "assistant", texts[0])], "conv_id long, turn long, role string, text string")
    assert 50256 not in chat.format_chats(alone).first().ids


def test_plan_is_a_packing():
    rng = np.random.default_rng(4)
    for capacity in (1, 2, 3, 7, 31, 200):
        for _ in range(25):
            lengths = rng.integers(1, capacity + 1, rng.integers(0, 400))
            plan = packing.plan_bins(np.bincount(lengths, minlength=capacity + 1))
            fill = defaultdict(int)
            for n in range(1, capacity + 1):
                mine = plan[plan[:, 0] == n]
                for rank in range(int((lengths == n).sum())):
                    _, first, bin_no, per, _ = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
                    fill[bin_no + (rank - first) // per] += n
            assert sum(fill.values()) == lengths.sum() and max(fill.values(), default=0) <= capacity
            assert len(fill) <= 11 / 9 * -(-lengths.sum() // capacity) + 4 or (lengths > capacity // 3).any()


def test_token_binary_round_trip(spark, docs, table, tmp_path):
    tokenizer = offset_tokenizer()
    for source in (docs, table):
        packed = binary.write_packed(binary.pack_token_ids(source), f"{tmp_path}/{source.count()}")
        rows = packed.collect()
        assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
        for r in rows:
            assert len(r.ids) == 4096 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
            assert set(np.frombuffer(r.ids, "<u2")[r.n_tokens :]) <= {binary.END_ID}
        back = defaultdict(list)
        for r in binary.unpack_documents(packed).collect():
            back[r.doc_id].append((r.start, tuple(r.ids)))
        want, lengths = defaultdict(list), []
        for r in source.collect():
            ids = (*tokenizer.encode(r.text or "", add_special_tokens=False).ids, binary.END_ID)
            want[r.doc_id] += [(s, ids[s : s + 2048]) for s in range(0, len(ids), 2048)]
            lengths += [min(2048, len(ids) - s) for s in range(0, len(ids), 2048)]
        assert {k: as_key(v) for k, v in back.items()} == {k: as_key(v) for k, v in want.items()}
        assert as_key(2048 - r.n_tokens for r in rows) == as_key(one_by_one(lengths, 2048))  # one packing of the whole table
    sizes = lambda df: sorted(r.n_tokens for r in binary.pack_token_ids(df).select("n_tokens").collect())
    assert sizes(docs.repartition(7)) == sizes(docs.coalesce(1)) == sorted(r.n_tokens for r in binary.pack_token_ids(docs).collect())
    assert binary.pack_token_ids(none_of(docs)).count() == 0
    whole = lambda df: sorted((r.sequence_id, bytes(r.ids), r.cu_seqlens, r.starts, [(i is not None, i) for i in r.doc_ids]) for r in binary.pack_token_ids(df).collect())
    again = docs.unionByName(docs.where("doc_id < 9"))
    once = whole(again.coalesce(1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (8, 32):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert whole(again.repartition(n)) == once
    spark.conf.set("spark.sql.shuffle.partitions", before)


def one_by_one(lengths, capacity):
    """The rooms left by best-fit-decreasing, piece after piece."""
    rooms = []
    for n in sorted(map(int, lengths), reverse=True):
        fit = [r for r in rooms if r >= n]
        rooms.remove(min(fit)) if fit else None
        rooms.append((min(fit) if fit else capacity) - n)
    return rooms


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(6)
    for capacity in (1, 2, 7, 64):
        for _ in range(30):
            lengths = rng.integers(1, capacity + 1, rng.integers(0, 200))
            plan = binary.plan_decreasing(np.bincount(lengths, minlength=capacity + 1))
            fill = defaultdict(int)
            for n in range(1, capacity + 1):
                mine = plan[plan[:, 0] == n]
                for rank in range(int((lengths == n).sum())):
                    _, first, bin_no, per, offset = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
                    fill[bin_no + (rank - first) // per] += n
            assert sorted(capacity - x for x in fill.values()) == sorted(one_by_one(lengths, capacity))


# URL filters


def test_url_filters_by_hand(spark):
    entries = spark.createDataFrame([("bad.com", "block", "2024-01-10"), ("bad.com", "remove", "2024-02-01"), ("ok.bad.com", "allow", "2024-01-20"), ("same.org", "allow", "2024-01-01"), ("same.org", "block", "2024-01-01"), (None, "block", "2024-01-01"), ("com", "odd", "2024-01-01"), ("bad.com", "block", None), ("bad.com", "allow", "someday"), (" Dotted.NET. ", "block", "2024-01-01"), ("[2001:db8::1]", "block", "2024-01-01"), ("", "block", "2024-01-01")], "domain string, action string, dated string")
    rows = [("http://bad.com/x", "2024-01-09", True), ("http://bad.com/x", "2024-01-10", False), ("https://u@A.BAD.com:8/", "2024-01-31", False), ("https://ok.bad.com", "2024-01-19", False), ("https://ok.bad.com", "2024-01-20", True), ("http://bad.com/x", "2024-02-01", True), ("http://notbad.com", "2024-01-15", True), ("ftp://x.same.org/a?b", "2024-05-05", False), (None, "2024-01-15", True), ("", "2024-01-15", True), ("http://bad.com", None, True), ("http://bad.com/x", "2024-01-10", False)]
    rows += [("  http://bad.com./x", "2024-01-15", False), ("//bad.com/x", "2024-01-15", False), ("bad.com/x?y", "2024-01-15", False), ("a.bad.com:80", "2024-01-15", False), ("http://bad.com", "not a date", True), ("http://bad.com", "2024-13-45", True), ("http://x.dotted.net", "2024-02-02", False), ("https://[2001:DB8::1]:443/", "2024-02-02", False), ("https://[2001:db8::2]/", "2024-02-02", True), ("http:\\\\bad.com", "2024-01-15", False), ("mailto", "2024-01-15", True), ("\thttp://bad.com\n", "2024-01-15", False)]
    captures = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, url string, fetched string, want boolean").selectExpr("*", "1 as Host", "2 as domain", "3 as starts", "4 as hit", "5 as _on", "6 as on", "7 as day", "8 as other", "9 as KEPT")
    got = urls.filter_urls(captures, entries).collect()
    assert len(got) == len(rows) and all(r.kept == r.want for r in got)
    assert urls.filter_urls(none_of(captures), entries).count() == 0
    assert urls.filter_urls(captures, none_of(entries)).where("kept").count() == len(rows)


# queries and SQL


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert as_key(map(tuple, df.select(*names).collect())) == as_key(want)
