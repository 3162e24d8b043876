"""Routing of requests: keyword classification, targets, budget, quality metrics and drift."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add
from typing import Protocol

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import free_names, join_null_safe
from plumbline.functions.order import running_total
from plumbline.scratch import materialize

# The domains in order, their default keywords, tier costs (in thousandths) and tiers.
DOMAINS = ["Clear", "Complicated", "Complex", "Chaotic", "Disorder"]
KEYWORDS = {
    "Clear": ["what is", "define", "look up", "how many"],
    "Complicated": ["why did", "cause", "effect", "impact", "correlation", "regression", "because"],
    "Complex": ["uncertain", "probability", "might", "explore", "what if", "scenario", "predict"],
    "Chaotic": ["emergency", "crisis", "outage", "breach", "urgent", "critical failure"],
}
TIER_MILLS = {"free": 0, "low": 10, "medium": 50, "high": 200}
DOMAIN_TIER = {"Clear": "free", "Complicated": "low", "Complex": "medium", "Chaotic": "high", "Disorder": "free"}
#: Keywords that one automaton holds, more or less.
KEYWORD_BLOCK = 50_000
#: Characters, as in a regular expression's class, that part lower-case texts into runs: ASCII other than a to z.
BREAKS = r"\x00-\x60\x7B-\x7F"
#: 1 for the bytes of UTF-8 that are not breaks.
IN_RUN = np.ones(256, np.int8)
IN_RUN[:0x61] = IN_RUN[0x7B:0x80] = 0
#: Bytes of text, more or less, whose runs are numbered together.
CHUNK_BYTES = 1 << 23
THRESHOLD, FALLBACK, TIMEOUT_MS = 0.3, "Disorder", 30_000


def classify(df: DataFrame, text: str, keywords: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """``df`` with domain, confidence and all_scores (best first).

    A domain's score is the share of its keywords found as substrings, ignoring case. The
    first domain in order wins ties; nothing found is Disorder with 0. A fixed set of
    column expressions: no join and no shuffle.
    """
    table = KEYWORDS if keywords is None else keywords
    ranked = [d for d in DOMAINS if d in table] + [d for d in table if d not in DOMAINS]
    lowered, listed = free_names([*df.columns, "domain", "confidence", "all_scores"], "lowered", "scored")
    df = df.withColumn(lowered, F.lower(F.coalesce(text, F.lit(""))))
    low = F.col(lowered)
    score = lambda ks: reduce(add, (F.contains(low, F.lit(k.lower())).cast("int") for k in ks), F.lit(0)) / F.lit(float(max(len(ks), 1)))
    scores = F.array(*(F.struct((-score(table[d])).alias("n"), F.lit(i).alias("i"), F.lit(d).alias("domain")) for i, d in enumerate(ranked)))
    best = df.withColumn(listed, F.sort_array(scores)).drop(lowered)  # no lambda, so it stays in generated code
    top = -F.col(listed)[0]["n"]
    return best.withColumns({"domain": F.when(top > 0, F.col(listed)[0]["domain"]).otherwise(FALLBACK), "confidence": F.when(top > 0, top).otherwise(0.0), "all_scores": F.array(*(F.struct(F.col(listed)[i]["domain"].alias("domain"), (-F.col(listed)[i]["n"]).alias("score")) for i in range(len(ranked))))}).drop(listed)


def _find(words: list[tuple[str, list[int]]]):
    """Rows (place, low) -> (place, code, n): how many of a domain's words each text holds, in one pass over the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = ahocorasick.Automaton()
        for k, (word, own) in enumerate(words):
            matcher.add_word(word, (k, own))
        matcher.make_automaton()
        for batch in batches:
            place, code, n = [], [], []
            for at, low in zip(batch.column("place").to_pylist(), batch.column("low").to_pylist()):
                met = dict(value for _, value in matcher.iter(low)) if words else {}
                per = Counter(d for own in met.values() for d in own)
                place += [at] * len(per)
                code += per.keys()
                n += per.values()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (place, code, n)], ["place", "code", "n"])

    return run


def _phrase_hits(texts: DataFrame, phrases: DataFrame, many: int, block: int) -> DataFrame:
    """(place, code, n) by automata of about ``block`` keywords; each reads all texts."""
    blocks, found = max(-(-many // block), 1), []
    for b in range(blocks):
        own: dict[str, list[int]] = {}
        for code, keyword in phrases.select("code", "keyword").where(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == b).toLocalIterator():
            own.setdefault(keyword, []).append(code)
        found.append(texts.mapInArrow(_find(list(own.items())), "place long, code long, n long"))
    return reduce(DataFrame.unionByName, found)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows (place, low) again, in tables of about ``size`` bytes of text, or one longer text."""
    held, room = [], size
    for batch in batches:
        ends, begin = np.cumsum(np.asarray(pc.binary_length(batch.column("low")), np.int64)), 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(int(np.searchsorted(ends, before + room, "right")), begin + 1)
            held.append(batch.slice(begin, end - begin))
            room, begin = room - int(ends[end - 1] - before), end
            if room <= 0 or begin < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, room = [], size
    if held:
        yield pa.Table.from_batches(held)


def _different(x: np.ndarray) -> np.ndarray:
    """The different whole numbers in order; a plain sort, which np.unique is several times slower than."""
    x = np.sort(x)
    return x[np.diff(x, prepend=x[:1] - 1) > 0]


def _numbered_runs(shortest: int, size: int = CHUNK_BYTES):
    """Rows (place, low), each text ending in a break -> a row for each text and one for each different run of a chunk of texts.

    A text is (chunk, place, runs), its different runs by their numbers within the chunk; a run is (chunk, number, run).
    """
    names = ["chunk", "place", "runs", "number", "run"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in enumerate(_chunks(batches, size), TaskContext.get().partitionId() << 32):
            texts = table["low"].combine_chunks().cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
            text = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]]
            edges = np.diff(IN_RUN[text], prepend=0, append=0)
            begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            long = (end - begin >= shortest) & (begin >= offsets[0])
            begin, lengths = begin[long], (end - begin)[long]
            places = np.concatenate([[0], np.cumsum(lengths)])
            letters = text[np.repeat(begin - places[:-1], lengths) + np.arange(places[-1])]
            coded = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(places), pa.py_buffer(letters)).dictionary_encode()
            known, n, m = coded.dictionary, len(texts), len(coded.dictionary)
            met = _different((np.searchsorted(offsets, begin, "right") - 1) * max(m, 1) + np.asarray(coded.indices))  # a text's run once
            ends = np.cumsum(np.bincount(met // max(m, 1), minlength=n))
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(met % max(m, 1), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), table["place"].combine_chunks(), runs, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), pa.nulls(m, pa.int64()), pa.nulls(m, runs.type), pa.array(np.arange(m), pa.int32()), known.cast(pa.string())], names)

    return split


def _substrings(lengths: list[int]):
    """Rows (id, run) -> (id, keyword): the different substrings of a run that are as long as some keyword."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []
        for batch in batches:
            for at, run in zip(batch.column("id").to_pylist(), batch.column("run").to_pylist()):
                for size in lengths:
                    if size > len(run):
                        break
                    own = {run[i : i + size] for i in range(len(run) - size + 1)}
                    ids += [at] * len(own)
                    parts += own
                    if len(ids) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.string())], ["id", "keyword"])
                        ids, parts = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.string())], ["id", "keyword"])

    return cut


def _count_by_text(texts: pa.Table, runs: pa.Table) -> pa.Table:
    """A chunk's texts (place, runs) and runs (number, words, codes) -> (place, code, n), each word once a text."""
    if not texts.num_rows or not runs.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("place", "code", "n")})
    lists, words = texts["runs"].combine_chunks(), runs["words"].combine_chunks()
    word, first, own = np.unique(np.asarray(words.flatten()), return_index=True, return_inverse=True)
    codes, of_word = np.unique(np.asarray(runs["codes"].combine_chunks().flatten())[first], return_inverse=True)
    number, run, held = np.asarray(runs["number"]), np.asarray(lists.flatten()), np.asarray(words.value_lengths(), np.int64)
    many, begin = np.zeros((2, max(number.max(), run.max(initial=0)) + 1), np.int64)
    many[number], begin[number] = held, np.cumsum(held) - held
    # every (text, run) is repeated for the run's words, then each (text, word) kept once
    reps, at = many[run], np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    where = np.repeat(begin[run] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
    pairs = _different(np.repeat(at, reps) * len(word) + own[where])
    cells = np.sort(pairs // len(word) * len(codes) + of_word[pairs % len(word)])
    start = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1))
    n, cells = np.diff(start, append=len(cells)), cells[start]
    return pa.table({"place": np.asarray(texts["place"])[cells // len(codes)], "code": codes[cells % len(codes)], "n": n})


def _run_hits(texts: DataFrame, plain: DataFrame, lengths: list[int]) -> DataFrame:
    """(place, code, n) for keywords without breaks: such a keyword lies within one run of the text.

    The texts are read once and kept by numbers of their runs. Each different run of the table is looked up
    once, by an equality join of its substrings; what it holds goes back to the chunks of texts that have it.
    """
    ended = texts.select("place", F.concat("low", F.lit(" ")).alias("low"))
    kept = materialize(ended.mapInArrow(_numbered_runs(lengths[0]), "chunk long, place long, runs array<int>, number int, run string"))
    by_chunk = kept.where("run is not null").select("chunk", "number", "run")
    runs = materialize(by_chunk.select("run").distinct().withColumn("id", F.monotonically_increasing_id()))
    met = runs.select("id", "run").mapInArrow(_substrings(lengths), "id long, keyword string").join(plain, "keyword")
    held = met.groupBy("id").agg(F.collect_list(F.struct("word", "code")).alias("words")).join(runs, "id").select("run", F.col("words.word").alias("words"), F.col("words.code").alias("codes"))
    found = by_chunk.join(held, "run").select(F.col("chunk").alias("of"), "number", "words", "codes")
    return kept.where("place is not null").select("chunk", "place", "runs").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_count_by_text, "place long, code long, n long")


def classify_by_table(df: DataFrame, text: str, keywords: DataFrame, block: int = KEYWORD_BLOCK) -> DataFrame:
    """``classify`` with a table of keywords (domain, keyword) of any size.

    Keywords without breaks (ASCII other than a to z) are looked up by joins, once for each different run
    between breaks that the texts have. The others are dealt into blocks of about ``block`` by hash; of
    each block an automaton finds all that a text holds in one pass over it. The counts are added up by
    text and domain. ``all_scores`` has the domains found, best first; ties go by the order of DOMAINS,
    then by name. Repeated rows of the table count once, rows with a null or an empty keyword
    or a null domain not at all; a null text holds nothing. ``df`` is written once, to give its
    rows numbers.
    """
    pairs = materialize(keywords.select("domain", F.lower("keyword").alias("keyword")).where("domain is not null and keyword <> ''").distinct())
    totals = materialize(pairs.groupBy("domain").agg(F.count("*").alias("total")).withColumn("code", F.monotonically_increasing_id()))
    broken = F.col("keyword").rlike(f"[{BREAKS}]").alias("broken")
    words = materialize(pairs.join(totals, "domain").select("code", "keyword", broken, F.monotonically_increasing_id().alias("word")))
    place, scored = free_names([*df.columns, "domain", "confidence", "all_scores"], "place", "scored")
    rows = materialize(df.drop("domain", "confidence", "all_scores").withColumn(place, F.monotonically_increasing_id()))
    texts = rows.select(F.col(place).alias("place"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    plain, phrases = words.where("not broken").select("word", "code", "keyword"), words.where("broken")
    lengths = sorted(r[0] for r in plain.select(F.length("keyword")).distinct().collect())
    many = phrases.count()
    found = [_run_hits(texts, plain, lengths)] if lengths else []
    found += [_phrase_hits(texts, phrases, many, block)] if many or not found else []
    hits = reduce(DataFrame.unionByName, found).groupBy("place", "code").agg(F.sum("n").alias("n"))
    first = reduce(lambda rest, i: F.when(F.col("domain") == DOMAINS[i], F.lit(i)).otherwise(rest), range(len(DOMAINS)), F.lit(len(DOMAINS)))
    share = (F.col("n") / F.col("total")).alias("share")
    ranked = hits.join(totals, "code").select("place", F.struct((-share).alias("n"), first.alias("i"), "domain").alias("s")).groupBy("place").agg(F.sort_array(F.collect_list("s")).alias(scored)).withColumnRenamed("place", place)
    best = F.col(scored)[0]
    listed = F.transform(F.coalesce(scored, F.array()), lambda s: F.struct(s["domain"].alias("domain"), (-s["n"]).alias("score")))
    return rows.join(ranked, place, "left").withColumns({"domain": F.coalesce(best["domain"], F.lit(FALLBACK)), "confidence": F.coalesce(-best["n"], F.lit(0.0)), "all_scores": listed}).drop(place, scored)


class QueryClassifier(Protocol):
    """Anything that adds domain, confidence and all_scores to a table of texts."""

    def classify(self, df: DataFrame, text: str) -> DataFrame: ...


@dataclass(frozen=True)
class KeywordClassifier:
    """``classify`` with its own keywords."""

    keywords: dict[str, Sequence[str]] = field(default_factory=lambda: dict(KEYWORDS))

    def classify(self, df: DataFrame, text: str) -> DataFrame:
        return classify(df, text, self.keywords)


@dataclass(frozen=True)
class TableClassifier:
    """``classify_by_table`` with its keywords."""

    keywords: DataFrame

    def classify(self, df: DataFrame, text: str) -> DataFrame:
        return classify_by_table(df, text, self.keywords)


@dataclass(frozen=True)
class Router:
    """A classifier, its targets and the rules of ``route``."""

    routes: DataFrame
    classifier: QueryClassifier = field(default_factory=KeywordClassifier)
    threshold: float = 0.3
    fallback: str = "Disorder"

    def route(self, df: DataFrame, text: str) -> DataFrame:
        return route(self.classifier.classify(df, text), self.routes, self.threshold, self.fallback)

    def route_with_budget(self, df: DataFrame, text: str, order: Sequence[str], budget_mills: int, keys: Sequence[str] = ()) -> DataFrame:
        return downgrade(spend(self.route(df, text), "tier", order, budget_mills, keys), self.routes)


def route_table(spark: SparkSession, routes: dict[str, tuple[str, str]]) -> DataFrame:
    """{domain: (url, tier)} -> (domain, url, timeout_ms, tier), the broadcast dimension of ``route``."""
    return spark.createDataFrame([(d, u, TIMEOUT_MS, t) for d, (u, t) in routes.items()], "target_domain string, url string, timeout_ms int, tier string")


def route(classified: DataFrame, routes: DataFrame, threshold: float = THRESHOLD, fallback: str = FALLBACK) -> DataFrame:
    """``classified`` with confident and the target's url, timeout_ms and tier (null without a route).

    Under the threshold the fallback's target is taken; ``domain`` stays as classified. Of
    several routes to one domain the first by url, timeout and tier counts. A table of any
    size is taken: the planner broadcasts it where its size allows.
    """
    sure = F.col("confidence") >= threshold
    used = classified.withColumns({"confident": sure, "target_domain": F.when(sure, F.col("domain")).otherwise(fallback)})
    one = routes.groupBy("target_domain").agg(F.min(F.struct("url", "timeout_ms", "tier")).alias("to")).select("target_domain", "to.*")
    return used.join(one, "target_domain", "left")


def cost_mills(tier: Column | str, costs: dict[str, int] | None = None) -> Column:
    col = F.col(tier) if isinstance(tier, str) else tier
    return reduce(lambda rest, kv: F.when(col == kv[0], F.lit(kv[1])).otherwise(rest), (costs or TIER_MILLS).items(), F.lit(None).cast("int"))


def spend(df: DataFrame, tier: str, order: Sequence[str], budget_mills: int, keys: Sequence[str] = (), costs: dict[str, int] | None = None) -> DataFrame:
    """``df`` with cost_mills, spent_mills, within, remaining_mills, overage_mills and suggested_tier.

    Costs are whole thousandths, so running sums are exact; spending the budget to the last
    is within. The suggestion beyond it is the free tier. Without ``keys`` there is one
    budget and one order; its running total is made of sums per range, not in one task, from
    rows written once. Rows with null order come first. To reset budgets give the columns of
    ``functions.order.epochs`` as keys.
    """
    cost = F.coalesce(cost_mills(tier, costs), F.lit(0)).cast("long")
    if keys:
        total = F.sum("cost_mills").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        rows = df.withColumn("cost_mills", cost).withColumn("spent_mills", total)
    else:
        rows = running_total(df.withColumn("cost_mills", cost), F.col("cost_mills"), order, "spent_mills")
    left = F.lit(budget_mills) - F.col("spent_mills")
    over = left < 0
    return rows.withColumns({"within": ~over, "remaining_mills": F.greatest(left, F.lit(0)), "overage_mills": F.greatest(-left, F.lit(0)), "suggested_tier": F.when(over, F.lit("free"))})


def downgrade(spent: DataFrame, routes: DataFrame) -> DataFrame:
    """``spent`` with final_url: beyond the budget the first free route by domain order, if any. The charge stays."""
    order = reduce(lambda rest, i: F.when(F.col("target_domain") == DOMAINS[i], F.lit(i)).otherwise(rest), range(len(DOMAINS)), F.lit(len(DOMAINS)))
    (name,) = free_names([*spent.columns, "final_url"], "free")
    free = routes.where("tier = 'free'").agg(F.min_by("url", order).alias(name))
    return spent.crossJoin(F.broadcast(free)).withColumn("final_url", F.when(F.col("within"), F.col("url")).otherwise(F.coalesce(name, "url"))).drop(name)


def budget_summary(spent: DataFrame, tier: str, budget_mills: int) -> DataFrame:
    """(tier, routes, spent_mills, average_mills, utilization) per tier."""
    return spent.groupBy(F.col(tier).alias("tier")).agg(F.count("*").alias("routes"), F.sum("cost_mills").alias("spent_mills"), F.try_divide(F.sum("cost_mills"), F.count("*")).cast("double").alias("average_mills"), F.try_divide(F.sum("cost_mills"), F.lit(budget_mills)).cast("double").alias("utilization"))


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """(predicted, actual, n): the sparse confusion matrix."""
    return df.groupBy(F.col(predicted).alias("predicted"), F.col(actual).alias("actual")).agg(F.count("*").alias("n"))


def domain_metrics(matrix: DataFrame) -> DataFrame:
    """(domain, precision, recall, f1, accuracy, total) of the five domains and every other one met, 0 where undefined."""
    none = F.lit(0).cast("long")
    hit = F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(none)
    sides = F.array(F.struct(F.col("predicted").alias("domain"), F.col("n").alias("p"), none.alias("a"), hit.alias("tp")), F.struct(F.col("actual").alias("domain"), none.alias("p"), F.col("n").alias("a"), none.alias("tp")))
    fixed = matrix.sparkSession.createDataFrame([(d, 0, 0, 0) for d in DOMAINS], "domain string, p long, a long, tp long")
    tall = matrix.select(F.explode(sides).alias("x")).select("x.*").unionByName(fixed).where("domain is not null")
    got = tall.groupBy("domain").agg(F.sum("tp").alias("tp"), F.sum("p").alias("np"), F.sum("a").alias("na"))
    whole = matrix.agg(F.coalesce(F.sum(hit), none).alias("ok"), F.sum("n").alias("total"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0)).cast("double")
    p, r = ratio(F.col("tp"), F.col("np")), ratio(F.col("tp"), F.col("na"))
    return got.crossJoin(F.broadcast(whole)).select("domain", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.col("ok"), F.col("total")).alias("accuracy"), "total")


def misrouting_cost(matrix: DataFrame, costs: dict[str, int] | None = None) -> DataFrame:
    """(cost_mills): what wrongly predicted domains cost by their fixed tiers."""
    tier = reduce(lambda rest, kv: F.when(F.col("predicted") == kv[0], F.lit(kv[1])).otherwise(rest), DOMAIN_TIER.items(), F.lit("free"))
    return matrix.where("predicted <> actual").agg(F.coalesce(F.sum(F.col("n") * cost_mills(tier, costs)), F.lit(0)).alias("cost_mills"))


def drift(current: DataFrame, reference: DataFrame, threshold: float, keys: Sequence[str] = (), domains: Sequence[str] = tuple(DOMAINS)) -> DataFrame:
    """(keys, kl, drifted, n): KL(current || reference) in nats over ``domains``, the five unless given.

    Both sides are (keys, domain, n); other domains do not count. Shares under 1e-10 are raised
    to it, without scaling again. An empty side gives 0 and no drift. A null key is a key.
    """
    c, r = domain_shares(current, "c", keys, domains), domain_shares(reference, "r", keys, domains)
    both = join_null_safe(c, r, keys, "left").na.fill(0, [f"r{i}" for i in range(len(domains))]) if keys else c.crossJoin(r)
    return both.select(*keys, *drift_columns(len(domains), threshold))


def count_columns(name: str, n: Column, domains: Sequence[str]) -> list[Column]:
    """A sum of ``n`` for each domain, as name0, name1, ..."""
    return [F.coalesce(F.sum(F.when(F.col("domain") == d, n)), F.lit(0)).alias(f"{name}{i}") for i, d in enumerate(domains)]


def domain_shares(df: DataFrame, name: str, keys: Sequence[str], domains: Sequence[str]) -> DataFrame:
    sums = count_columns(name, F.col("n"), domains)
    return df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)


def drift_columns(k: int, threshold: float) -> list[Column]:
    """kl, drifted and n of the counts c0.. against r0.., k of each."""
    total = lambda n: reduce(add, (F.col(f"{n}{i}") for i in range(k)))
    share = lambda n, i: F.greatest(F.try_divide(F.col(f"{n}{i}"), total(n)).cast("double"), F.lit(1e-10))
    kl = F.when((total("c") > 0) & (total("r") > 0), reduce(add, (share("c", i) * F.log(share("c", i) / share("r", i)) for i in range(k)))).otherwise(0.0)
    return [kl.alias("kl"), (kl > threshold).alias("drifted"), total("c").alias("n")]
