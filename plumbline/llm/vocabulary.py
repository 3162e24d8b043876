"""Public tokenizer files: where they are, and one encoder per Python worker."""

from __future__ import annotations

import base64
import functools
import json
import os
from collections.abc import Callable

import numpy as np
import tiktoken

#: Fixed value: the pre-tokenisation pattern that belongs to the byte-level vocabulary.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def file_path(name: str, folder: str | None = None) -> str:
    """A tokenizer file: of ``folder``, else of the installed public ones."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.lru_cache(maxsize=4)
def _ranks(folder: str | None) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The faster library's encoder, and how many bytes each id spells."""
    with open(file_path("byte_bpe_50k.tiktoken", folder), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = list(map(len, ranks))
    return tiktoken.Encoding("byte_bpe_50k", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def _overflowed(e: BaseException) -> bool:
    """Whether an endless run of white space overflowed the stack of the library's regular expression."""
    return type(e).__name__ == "PanicException"


@functools.lru_cache(maxsize=4)
def offset_tokenizer(folder: str | None = None):
    """The tokenizer file as it is, which reports offsets; an added token's string in a text gets that token's id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file_path("byte_bpe_50k.json", folder))


@functools.lru_cache(maxsize=4)
def literal_tokenizer(folder: str | None = None):
    """The same vocabulary; control strings in texts are ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(offset_tokenizer(folder).to_str())
    t.encode_special_tokens = True
    return t


@functools.lru_cache(maxsize=4)
def _added(folder: str | None) -> tuple[str, ...]:
    """The strings of the file's added tokens."""
    with open(file_path("byte_bpe_50k.json", folder), encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f)["added_tokens"])


def byte_encoder(folder: str | None = None) -> Callable[[str], list[int]]:
    """text -> ids of byte_bpe_50k, equal to the tokenizer file's own with add_special_tokens=False."""
    fast, added = _ranks(folder)[0].encode_ordinary, _added(folder)

    def encode(text: str) -> list[int]:
        if any(x in text for x in added):
            return offset_tokenizer(folder).encode(text, add_special_tokens=False).ids
        try:
            return fast(text)
        except BaseException as e:
            if not _overflowed(e):
                raise
            return offset_tokenizer(folder).encode(text, add_special_tokens=False).ids

    return encode


def literal_encoder(folder: str | None = None) -> Callable[[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """text -> ids of byte_bpe_50k with the first and the end character of each, control strings being ordinary text.

    Ids spell the text's bytes one after another, so their places are sums of their sizes; an id
    that spells part of a character has that whole character.
    """
    library, sizes = _ranks(folder)

    def encode(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        try:
            ids = np.array(library.encode_ordinary(text), np.int32)
        except BaseException as e:
            if not _overflowed(e):
                raise
            code = literal_tokenizer(folder).encode(text, add_special_tokens=False)
            return np.array(code.ids, np.int32), *np.array(code.offsets, np.int32).reshape(-1, 2).T
        ends = np.cumsum(sizes[ids])
        starts = ends - sizes[ids]
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) > len(text):
            character = np.cumsum((raw & 0xC0) != 0x80) - 1
            starts, ends = character[starts], character[ends - 1] + 1
        return ids, starts.astype(np.int32), ends.astype(np.int32)

    return encode
