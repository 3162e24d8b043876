"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Text is marked (spaces become U+2581, one is put in front) and cut before each run of marks
into marked words, which no piece of a usable model crosses. A batch's distinct words are
sorted, which is a depth-first walk of their trie: the forward states of a word's prefix
stay on a stack and are reused by all words that share it.

A state is the best way to reach a prefix. For a unigram model that is the highest sum of
scores. A byte-pair model is not additive: there the state is the last piece of the
prefix's own encoding, and a piece may follow if the two are exactly how the model encodes
their joined text. That local test is equivalent to merging by priority, so the result is
the model's own.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import arrow_limits, settled, text_slices
from plumbline.llm.vocabulary import file_path

MARK = "▁"
#: Characters of encoded words, and tests of neighbours, that a Python worker remembers between batches.
REMEMBER_CHARS, REMEMBER_TESTS = 6_000_000, 1_500_000


class PieceModel:
    """Pieces, scores and byte fallback; ``additive``: unigram scores, else byte-pair priorities."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: dict[int, int], unknown: int, additive: bool):
        if bad := [p for p in pieces if MARK in p.lstrip(MARK)]:
            raise ValueError(f"pieces cross marked words: {bad[:3]}")
        self.pieces, self.byte_ids, self.unknown, self.additive = pieces, byte_ids, unknown, additive
        self.known: dict[str, bytes] = {}
        self.known_chars = self.tests = 0
        # pieces backwards, a node: (nodes by character, [piece, what may stand before it])
        self.backward: tuple[dict, list] = ({}, [])
        for p in pieces:
            at = self.backward
            for c in reversed(p):
                at = at[0].setdefault(c, ({}, []))
            at[1][:] = (p, {})
        self.packed = {p: struct.pack("<i", i) for p, (i, _) in pieces.items()}
        self.floor = min((s for _, s in pieces.values()), default=0.0) - 10.0
        size = 1 + max([unknown, *(i for i, _ in pieces.values()), *byte_ids.values()])
        self.spelling = [b""] * size
        for p, (i, _) in pieces.items():
            self.spelling[i] = p.replace(MARK, " ").encode()
        for b, i in byte_ids.items():
            self.spelling[i] = bytes([b])
        self.spelled = pa.array(self.spelling, pa.large_binary())

    def merged(self, text: str) -> list[str]:
        """Byte-pair encoding straight from its definition: merge the best-scored neighbours, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.pieces.get(parts[i] + parts[i + 1])
                if found and (best is None or found[1] > best):
                    best, at = found[1], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _step(self, word: str, end: int, last: list[str], score: list[float]) -> None:
        """Append the state of word[:end]: the best sum of scores."""
        at, best, value, begin = self.backward, None, 0.0, end
        while begin and (at := at[0].get(word[begin - 1])) is not None:
            begin -= 1
            if at[1] and (best is None or score[begin] + self.pieces[at[1][0]][1] > value):
                best, value = at[1][0], score[begin] + self.pieces[at[1][0]][1]
        char = word[end - 1]
        if char not in self.pieces and (best is None or score[end - 1] + self.floor > value):
            best, value = char, score[end - 1] + self.floor
        if best is None:
            raise ValueError(f"no piece sequence reaches {word[:end]!r}")
        last.append(best)
        score.append(value)

    def _steps(self, word: str, begin: int, last: list[str]) -> None:
        """Append the states of word[: begin + 1] and on: the last piece, the one that may follow the state before it."""
        root = self.backward
        for end in range(begin + 1, len(word) + 1):
            at, here = root, end
            while here:
                here -= 1
                at = at[0].get(word[here])
                if at is None:
                    best = None
                    break
                if at[1]:
                    best, may = at[1]
                    before = last[here]
                    good = may.get(before)
                    if good is None:
                        self.tests += 1
                        good = may[before] = self.merged(before + best) == ([before, best] if before else [best])
                    if good:
                        break
            else:
                best = None
            if best is None:
                best = word[end - 1]
                if best in self.pieces:
                    raise ValueError(f"no piece sequence reaches {word[:end]!r}")
            last.append(best)

    def _ids(self, piece: str) -> bytes:
        """The packed ids of a character that is no piece."""
        ids = [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]
        return struct.pack(f"<{len(ids)}i", *ids)

    def _forget(self) -> None:
        if self.known_chars > REMEMBER_CHARS:
            self.known.clear()
            self.known_chars = 0
        if self.tests > REMEMBER_TESTS:
            nodes = [self.backward]
            while nodes:
                children, own = nodes.pop()
                nodes += children.values()
                if own:
                    own[1].clear()
            self.tests = 0

    def learn(self, words: list[str]) -> None:
        """Encode the words that are new, sorted, on one stack of prefix states."""
        self._forget()
        last, score, before, packed = [""], [0.0], "", self.packed
        for word in sorted(set(words) - self.known.keys()):
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del last[same + 1 :]
            if self.additive:
                del score[same + 1 :]
                for end in range(same + 1, len(word) + 1):
                    self._step(word, end, last, score)
            else:
                self._steps(word, same, last)
            out = []
            end = len(word)
            while end:
                piece = last[end]
                out.append(packed.get(piece) or self._ids(piece))
                end -= len(piece)
            out.reverse()
            self.known[word] = b"".join(out)
            self.known_chars += len(word)
            before = word

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, flat ids) of each text; null and empty texts have none."""
        offsets, words = marked_words(texts)
        coded = words.dictionary_encode()
        own = coded.dictionary.to_pylist()
        self.learn(own)
        each = [self.known[w] for w in own]
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<i4")
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = size[codes]
        ends = np.concatenate(([0], np.cumsum(n)))
        place = np.repeat((np.cumsum(size) - size)[codes] - ends[:-1], n) + np.arange(ends[-1])
        return ends[offsets], flat[place]

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The texts of encoded ids: spelled out, marks as spaces, without the one put in front."""
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.spelled.take(pa.array(ids)))
        return [x.decode(errors="replace")[1:] for x in pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).to_pylist()]


def marked_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row offsets and marked words, cut before each run of marks."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    full = pc.not_equal(texts, "")
    marked = pc.replace_substring(pc.if_else(full, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), texts), " ", MARK)
    if pc.any(pc.match_substring(texts, "\0")).as_py():
        lists = pa.array([re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", x) for x in marked.to_pylist()], pa.large_list(pa.large_string()))
    else:
        lists = pc.split_pattern(pc.replace_substring_regex(marked, f"({MARK}+)", "\0\\1"), "\0")
    flat = pc.list_flatten(lists)
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(keep)))
    return before[np.concatenate(([0], np.cumsum(counts)))].astype(np.int64), flat.filter(pa.array(keep))


@functools.lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    """A model file that marks spaces, puts one mark in front and has no other normalisation."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as f:
        raw = f.read()
    spec = proto.ModelProto()
    spec.ParseFromString(raw)
    rules = spec.normalizer_spec
    if not rules.add_dummy_prefix or rules.remove_extra_whitespaces or rules.precompiled_charsmap:
        raise ValueError("the model normalises text; only identity normalisation with a mark in front is supported")
    p = SentencePieceProcessor(model_proto=raw)
    ids = range(p.piece_size())
    byte_ids = {int(p.id_to_piece(i)[1:-1], 16): i for i in ids if p.is_byte(i)}
    pieces = {p.id_to_piece(i): (i, p.get_score(i)) for i in ids if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))}
    return PieceModel(pieces, byte_ids, p.unk_id(), spec.trainer_spec.model_type == proto.TrainerSpec.UNIGRAM)


def encode_pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids) for every row: whole texts, no shuffle.

    Null and empty texts have no ids; a null doc_id stays null; repeated rows are encoded each;
    other columns are left out; an empty table gives an empty result. ``path``: the model file
    (None: the installed public one).
    """
    path = path or file_path("piece_bpe_32k.model")
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                offsets, ids = model.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), lists], ["doc_id", "text", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(settled(run), "doc_id long, text string, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text that its ids spell (null ids: empty).

    A column of that name, in any case of letters, is replaced; an empty table gives an empty result.
    """
    path = path or file_path("piece_bpe_32k.model")
    names = [c for c in encoded.columns if c.lower() != "decoded"]
    encoded = encoded.select(*names)
    schema = encoded.withColumn("decoded", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column("ids")
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = model.decode(np.concatenate(([0], np.cumsum(counts))), pc.list_flatten(lists).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(settled(run), schema)
