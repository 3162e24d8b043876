"""Embedding near-duplicates from int8 tile products with rigorous error bounds.

Vectors are scaled to unit length and quantised to int8 with a step of their own: v = s*q + e,
where |e| is measured per vector. For two vectors v.w lies within |e_v|*|s_w q_w| + |e_w|
of s_v*s_w*(q_v.q_w), as v.w = (s_v q_v).(s_w q_w) + e_v.(s_w q_w) + v.e_w and |v| = 1.
Tiles of vectors with one label are multiplied in integers (exact in float32 up to 1,024
components, in float64 beyond).

1. Identical vectors of one label are merged into classes, each with a number of its own.
2. Classes are quantised once and dealt into tiles by hash. A tile holds the int8 rows, steps
   and errors only, TILE rows or TILE_BYTES at most.
3. Each pair of tiles of a label is one row, so a label with most rows is spread over many
   tasks. The products say which classes have a partner that the bound cannot exclude.
4. For those classes alone the vectors are fetched, by pair of tiles, and just the pairs that
   may reach the limit are recomputed in double precision. A pair of tiles gives counts per
   class and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import connected_components
from plumbline.llm.tables import arrow_limits, materialize, release, settled

LIMIT = 0.98
#: Rows and int8 bytes that a tile holds at most.
TILE, TILE_BYTES = 8192, 2 << 20
#: A block with one possible pair in so many is multiplied whole.
DENSE = 8


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> int8 rows, their steps, and the measured length of each row's error."""
    step = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127
    q = np.rint(unit / step[:, None]).astype(np.int8)
    return q, step, np.linalg.norm(unit - q * step[:, None], axis=1)


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]  # int8 rows, steps, errors


def possible(a: Rows, b: Rows, limit: float, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of quantised rows whose cosine may reach the limit, block by block."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    kind = np.float32 if qa.shape[1] <= 1024 else np.float64
    right = qb.T.astype(kind)
    long_b = np.linalg.norm(qb * sb[:, None], axis=1)
    for at in range(0, len(qa), block):
        rows = slice(at, at + block)
        dots = qa[rows].astype(kind) @ right
        slack = ea[rows][:, None] * long_b[None, :] + eb[None, :] + 1e-6
        i, j = np.nonzero(dots * (sa[rows][:, None] * sb[None, :]) >= limit - slack)
        yield i + at, j


def near_pairs(a: np.ndarray, b: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine(a[i], b[j]) >= limit in double precision."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ua, ub = a / na[:, None], b / nb[:, None]
    for i, j in possible(quantise(ua), quantise(ub), limit):
        rows = np.unique(i)
        if len(i) * DENSE > len(rows) * len(b):  # one product in double precision is less work
            dots = ua[rows] @ ub.T
            open_ = dots >= limit - 1e-9
            sure = dots >= limit + 1e-9  # beyond any difference in the order of summing
            x, y = np.nonzero(sure)
            yield rows[x], y
            x, y = np.nonzero(open_ & ~sure)
            i, j = rows[x], y
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            sure = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= limit
            yield x[sure], y[sure]


class _Forest:
    """Links of a tile pair, reduced to a spanning forest."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, xs: np.ndarray, ys: np.ndarray) -> None:
        """Unite the ends of many links at once: the greater root goes under the least root that it meets, until none is left."""
        root = self.root
        while len(xs):
            a, b = root[xs], root[ys]
            live = a != b
            xs, ys = xs[live], ys[live]
            np.minimum.at(root, np.maximum(a, b)[live], np.minimum(a, b)[live])
            while (root[root] != root).any():
                root[:] = root[root]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        below = np.flatnonzero(self.root != np.arange(len(self.root)))
        return below, self.root[below]


def _vectors(column: pa.Array) -> np.ndarray:
    """A list column, all of one length, as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, embedding, ...) with the embedding as int8 bytes, step and error."""
    for batch in batches:
        size = batch.column("dim").to_numpy()
        for dim in np.unique(size):
            part = batch.filter(pa.array(size == dim))
            vectors = _vectors(part.column("embedding"))
            q, step, error = quantise(vectors / np.linalg.norm(vectors, axis=1)[:, None])
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(int(dim)), len(q), [None, pa.py_buffer(q.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("place", "dim", "tiles", "tile", "class")), rows, pa.array(step), pa.array(error)], ["place", "dim", "tiles", "tile", "class", "q", "step", "error"])


def _rows(members: pa.ListArray, k: int, dim: int) -> tuple[np.ndarray, Rows]:
    own = members[k].values
    q = np.frombuffer(b"".join(own.field("q").to_pylist()), np.int8).reshape(-1, dim)
    return own.field("class").to_numpy(), (q, own.field("step").to_numpy(), own.field("error").to_numpy())


def _candidates(limit: float):
    """Pairs of tiles -> (place, a, b, side, class) of the classes with a possible partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dim, a, b = (batch.column(c)[k].as_py() for c in ("dim", "a", "b"))
                ids, left = _rows(batch.column("left"), k, dim)
                others, right = (ids, left) if a == b else _rows(batch.column("right"), k, dim)
                hits = [np.zeros(len(ids), bool), np.zeros(len(others), bool)]
                for i, j in possible(left, right, limit):
                    if a == b:
                        i, j = i[i < j], j[i < j]
                    hits[0][i] = True
                    hits[1][j] = True
                if a == b:
                    hits = [hits[0] | hits[1], hits[1][:0]]
                found = np.concatenate([x[hit] for x, hit in zip((ids, others), hits) if len(hit)])
                n = [int(h.sum()) for h in hits]
                place = pa.array([batch.column("place")[k].as_py()] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([place, pa.array(np.full(len(found), a, np.int32)), pa.array(np.full(len(found), b, np.int32)), pa.array(np.repeat([0, 1], n).astype(np.int32)), pa.array(found)], ["place", "a", "b", "side", "class"])

    return run


def _exact(limit: float):
    """Pairs of tiles with the vectors of their candidates -> (class, links, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("a")[k].as_py() == batch.column("b")[k].as_py()
                own = batch.column("members")[k].values
                side, ids, copies = (own.field(c).to_numpy() for c in ("side", "class", "copies"))
                vectors = _vectors(own.field("embedding"))
                x = np.arange(len(ids)) if same else np.flatnonzero(side == 0)
                y = x if same else np.flatnonzero(side == 1)
                forest, links = _Forest(len(ids)), np.zeros(len(ids), np.int64)
                for i, j in near_pairs(vectors[x], vectors[y], limit):
                    if same:
                        i, j = i[i < j], j[i < j]
                    i, j = x[i], y[j]
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    forest.add(i, j)
                hit = np.flatnonzero(links)
                u, v = forest.links()
                found = np.concatenate((ids[hit], ids[u]))
                other = pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array(ids[v], pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.concatenate((links[hit], np.zeros(len(u), np.int64)))), other], ["class", "links", "other"])

    return run


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows are compared only when labels are equal and not null. A vector that is null, empty,
    zero, or holds a null or non-finite component links with nothing, nor do vectors of
    different lengths. n_links counts the other rows with cosine >= ``limit`` in double
    precision. Rows count as rows: repeated ones, and several vectors of one vec_id, each with
    its own links and component. A row without vec_id counts as a link and can join others but
    never names a component. kept: vec_id = component_id. Other columns do not matter, whatever
    their names. An empty table gives an empty result. Equal vectors are recognised by 128 bits
    of hashes, equal labels by 64.
    """
    arrow_limits(vectors.sparkSession)
    label, embedding = F.col(label_col), F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), embedding.alias("embedding"), label.alias("label"))
    fine = F.expr("coalesce(label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0), false)")
    keys = [F.when(fine, F.xxhash64(F.lit(i), "label", "embedding")).alias(f"h{i}") for i in (1, 2)]
    names = materialize(rows.select("vec_id", *keys))
    whole = rows.where(fine).groupBy(*keys).agg(F.first("embedding").alias("embedding"), F.xxhash64(F.first("label")).alias("place"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # numbers that hold once written: no two classes share one
    classes = materialize(whole.withColumns({"class": F.monotonically_increasing_id(), "dim": F.size("embedding")}))
    per_tile = F.greatest(F.least(F.lit(tile), F.floor(F.lit(TILE_BYTES) / F.col("dim"))), F.lit(1))
    sizes = materialize(classes.groupBy("place", "dim").agg(F.count("*").alias("n")).select("place", "dim", F.ceil(F.col("n") / per_tile).cast("int").alias("tiles")))
    dealt = classes.join(sizes, ["place", "dim"]).select("place", "dim", "tiles", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int").alias("tile"), "class", "embedding")
    coded = dealt.mapInArrow(settled(_quantised), "place long, dim int, tiles int, tile int, class long, q binary, step double, error double")
    tiles = materialize(coded.groupBy("place", "dim", "tiles", "tile").agg(F.collect_list(F.struct("class", "q", "step", "error")).alias("members")))
    alone = tiles.select("place", "dim", F.col("tile").alias("a"), F.col("tile").alias("b"), F.col("members").alias("left"), F.lit(None).cast(tiles.schema["members"].dataType).alias("right"))
    many = tiles.where("tiles > 1")
    one = many.select("place", "dim", F.col("tile").alias("a"), F.explode(F.expr("sequence(0, tiles - 1)")).alias("b"), F.col("members").alias("left")).where("a < b")
    two = many.select("place", "dim", F.explode(F.expr("sequence(0, tiles - 1)")).alias("a"), F.col("tile").alias("b"), F.col("members").alias("right")).where("a < b")
    pairs = alone.unionByName(one.join(two, ["place", "dim", "a", "b"]))
    asked = materialize(pairs.mapInArrow(settled(_candidates(limit)), "place long, a int, b int, side int, class long"))
    fetched = asked.join(classes.select("class", "embedding", "copies", "dim"), "class").groupBy("place", "dim", "a", "b").agg(F.collect_list(F.struct("side", "class", "copies", "embedding")).alias("members"))
    found = materialize(fetched.select("a", "b", "members").mapInArrow(settled(_exact(limit)), "class long, links long, other long"))
    parts = connected_components(found.where("other is not null").select(F.col("class").alias("u"), F.col("other").alias("v")))
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    grouped = materialize(classes.select("class", "h1", "h2", "least", "copies").join(parts, F.col("class") == F.col("node"), "left").join(counts, "class", "left").select("h1", "h2", "least", F.coalesce("component", "class").alias("part"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    # written before it is joined, so that a giant component's rows can be split over tasks
    least = materialize(grouped.groupBy("part").agg(F.min("least").alias("component_id")))
    ends = materialize(grouped.join(least, "part").select("h1", "h2", "component_id", "n_links"))
    release(classes, sizes, tiles, asked, found, parts, grouped, least)
    linked = names.where("h1 is not null").join(ends, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    single = names.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
