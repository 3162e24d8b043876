"""Chat formatting with offset-aligned loss masks.

A turn is rendered ``<role>\\n`` text ``</turn>\\n``. Inside roles and texts a backslash is
put before every backslash, ``<``, and, in roles, ``>`` and line end; a bare ``<`` therefore
opens a control string and nothing else, and reading back is exact. The whole conversation
is encoded once with offsets; the sorted spans of the turns to learn from are intersected
with the sorted token spans by binary search. A token that only partly lies in such a span
is masked in, and ``loss_spans`` holds the characters exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import arrow_limits, settled
from plumbline.llm.vocabulary import literal_encoder

_TURN = re.compile(r"<((?:\\.|[^\\>])*)>\n((?:\\.|[^\\<])*)</turn>\n", re.S)


def escape(text: str, role: bool = False) -> str:
    return re.sub(r"([\\<>\n])" if role else r"([\\<])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The formatted conversation, and (role, start, end) of each escaped text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<{escape(role, True)}>\n", escape(text)
        spans.append((role, at + len(head), at + len(head) + len(body)))
        out += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; ValueError if it is not one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def intersect(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Token mask and covered character ranges: sorted token spans against sorted disjoint turn spans."""
    mask, covered = np.zeros(len(starts), np.int8), []
    for a, b in spans:
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        mask[lo:hi] = 1
        if a < b and lo < hi:
            covered.append((max(a, int(starts[lo])), min(b, int(ends[hi - 1]))))
    return mask, covered


def format_chats(chats: DataFrame, learn: str = "assistant", folder: str | None = None) -> DataFrame:
    """(conv_id, n_turns, formatted, ids, starts, ends, loss_mask, loss_spans), one row per conv_id.

    ``chats`` has conv_id, turn, role and text, a row per turn; turns go by turn, then role,
    then text, null first, and repeated rows stay repeated turns. Null roles and texts are
    empty. A row without conv_id belongs to no other: it is a conversation of one turn, and
    such rows are never gathered. Other columns do not matter, whatever their names; an empty
    table gives an empty result. A conversation is one row of output and so must fit in a task;
    no other grouping is made.
    """
    arrow_limits(chats.sparkSession)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = chats.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    known = own.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    lone = own.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    grouped = known.unionByName(lone).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    schema = "conv_id long, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss_mask array<tinyint>, loss_spans array<struct<start:int,end:int>>"
    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int8()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    names = [x.split()[0] for x in re.split(r", (?=\w+ )", schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = literal_encoder(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                done = [render(list(zip(r, t))) for r, t in zip(part.column("roles").to_pylist(), part.column("texts").to_pylist())]
                rows = []
                for conv, (text, spans) in zip(part.column("conv_id").to_pylist(), done):
                    ids, starts, ends = encode(text)
                    mask, covered = intersect(starts, ends, [(a, b) for role, a, b in spans if role == learn])
                    rows.append((conv, len(spans), text, ids, starts, ends, mask, [{"start": a, "end": b} for a, b in covered]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return grouped.mapInArrow(settled(run), schema)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What reading ``format_chats`` output back gives: turns, and the text under the loss mask.

    A row each, whatever its columns' order and further columns: a conversation of any length
    that fits in a task, repeated ones told each. An empty table gives an empty result.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def under_mask(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray, spans: list) -> str:
        """Characters of masked tokens that lie in the loss spans, each once."""
        live = mask.astype(bool)
        starts, ends = starts[live], ends[live]
        out, at = [], 0
        for s in spans:
            lo, hi = np.searchsorted(ends, s["start"], "right"), np.searchsorted(starts, s["end"], "left")
            if lo == hi:
                continue
            b = np.minimum(ends[lo:hi], s["end"])
            before = np.concatenate(([max(at, s["start"])], np.maximum.accumulate(b)[:-1]))
            a = np.maximum(np.maximum(starts[lo:hi], s["start"]), before)
            keep = a < b
            a, b = a[keep], b[keep]
            if len(a):
                new = np.flatnonzero(a[1:] != b[:-1]) + 1
                out += [text[x:y] for x, y in zip(a[[0, *new]].tolist(), b[[*(new - 1), -1]].tolist())]
                at = int(b[-1])
        return unescape("".join(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(c) for c in ("conv_id", "formatted", "starts", "ends", "loss_mask", "loss_spans")]
            for i in range(batch.num_rows):
                conv, text, starts, ends, mask, spans = (c[i] for c in columns)
                text = text.as_py()
                mask = np.array(mask.values)
                turns = read_turns(text)
                loss = under_mask(text, np.array(starts.values), np.array(ends.values), mask, spans.as_py())
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((conv.as_py(), len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(mask), int(mask.sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    return formatted.mapInArrow(settled(run), schema)
