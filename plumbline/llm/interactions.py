"""Filter interaction audit: what each filter removes in every order of application.

Each document becomes a bit mask of the filters that it fails, and documents are counted by
(part, mask, label) before anything else happens: 2^5 masks and four kinds of label a part at
most. The distinct masks are unpivoted against the steps of all orders, and a running bit-or
window over each (mask, order) tells which failures an earlier step has removed already. What
a mask does at a step is the same for every part, so that table (600 rows a mask) is all that
meets the counted cells; conditional sums give a step's numbers and a window over a part's
filter their total over all orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import materialize

#: The filters: bit 0 is A.
LETTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails; null counts as empty.

    A: under 200 words. B: fewer distinct words than half of all. C: over two in a hundred code
    points are A-Z. D: one of ``#$%&*|``. A word is a run without ``SPACE`` characters.
    """
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long")
    tests = [F.size(words) < 200, 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"), 100 * capitals > 2 * F.length(t).cast("long"), t.rlike("[#$%&*|]")]
    bits = [F.when(failed, F.lit(1 << k)).otherwise(0) for k, failed in enumerate(tests)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents counted by source, failed filters and label.

    Texts are read once; what is shuffled is a row of numbers and a SHA-256 a document, which
    stands for the text when copies are looked for (filter E). The smallest doc_id of each
    text is found with map-side minima and met by (digest, doc_id), so that no group of copies
    meets in one task.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = materialize(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_failures(F.col("text")).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")))
    firsts = narrow.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    rows = narrow.join(firsts, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    again = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    mask = F.col("mask") + F.when(again, F.lit(16)).otherwise(0)
    return rows.groupBy("part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count("*").alias("n"))


def step_verdicts(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(mask, filter_order, step, letter, bit, fails, earlier): every mask at every step of every order.

    ``fails`` is the step's bit of the mask, ``earlier`` the bits of its failures at steps before.
    """
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    steps = masks.select("mask", F.explode(orders).alias("filter_order")).select("mask", "filter_order", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    bit = F.lit(0)
    for k, letter in enumerate(letters):
        bit = F.when(F.col("letter") == letter, F.lit(1 << k)).otherwise(bit)
    tall = steps.withColumn("step", F.col("at") + 1).withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return tall.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0))).drop("at")


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A row for each source of ``docs``, order of the filters A to E and step, zeros included.
    Null texts are empty, null sources the part ''. Filter E fails a document whose text a
    smaller doc_id has anywhere; a document without id never fails it and repeats of the
    smallest id do not either. Repeated rows count each; a document is good or toxic if any of
    its labels says so, and without an id or a label neither. Very long texts are read whole,
    one at a time. Other columns do not matter, whatever their names. An empty table gives an
    empty result.
    """
    cells = materialize(failure_cells(docs, labels))
    verdicts = step_verdicts(cells.select("mask").distinct())
    fails, earlier, n = F.col("fails") != 0, F.col("earlier") != 0, F.col("n")
    removed = fails & ~earlier
    total = lambda test: F.sum(F.when(test, n).otherwise(0))
    # 2^5 masks x 600 steps at most are broadcast; a part has 128 cells at most
    met = cells.repartition("part").join(F.broadcast(verdicts), "mask")
    steps = met.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~earlier).alias("kept"), total(removed).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"), total(removed & F.col("toxic")).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return steps.withColumn("shapley", shapley).drop("letter")
