"""Byte-level BPE of whole texts through the public tokenizer file.

Where ids follow the order of the merges, the file's merges are also ranks, which a second library
runs several times faster; ids are the same. Texts with the string of an added token, and texts
beyond U+024F, where classes of characters may differ by version, always go through the first.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per task

# White space that meets other white space, or a space or line end that ends the text.
_RUN = re.compile(r"[ \n]\s|\s[ \n]|[ \n]\Z")
_BEYOND = re.compile("[^\x00-\u024f]")
CACHE = 500_000

# Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def words(text: str) -> list[str]:
    """The text cut before each space and line end. A word after a space comes without it, a word
    after a line end with it."""
    return text.replace("\n", " \n").split(" ")


class Tokens:
    """Ids of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.special = [t["content"] for t in described["added_tokens"]]
        self.ranks = _ranks(described)

    def settled(self, text: str) -> bool:
        return (text.isascii() or not _BEYOND.search(text)) and not any(s in text for s in self.special)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        """Unsigned little-endian 32-bit ids."""
        if self.ranks and self.settled(text):
            return np.array(self.ranks.encode_ordinary(text), "<u4")
        return np.array(self.whole(text), "<u4")


class Lengths(dict):
    """Token counts of words, behind a bounded cache.

    No pre-token reaches across the start of white space, so a text is cut before its spaces and
    line ends and its count is the sum over its words; texts where white space meets a space or line
    end are encoded whole. ``frequent`` is a table shared by all tasks; what it lacks is encoded once
    and kept until ``CACHE`` words are held.
    """

    def __init__(self, tokens: Tokens, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokens, self.frequent = tokens, frequent

    def __missing__(self, word):
        text = word if word[:1] == "\n" else " " + word
        ranks = self.tokens.ranks
        self[word] = count = len(ranks.encode_ordinary(text) if ranks else self.tokens.whole(text))
        return count

    def of(self, text: str) -> int:
        if not self.tokens.settled(text) or _RUN.search(text):
            return len(self.tokens.whole(text))
        if len(self) > CACHE + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        first, *rest = words(text)
        return len(self.tokens.ids(first)) + sum(map(self.__getitem__, rest))


def _ranks(described):
    """The merges as ranks, if ids follow the order of the merges; else None."""
    try:
        import tiktoken
    except ImportError:
        return None
    if described["model"]["type"] != "BPE" or described["normalizer"] or described["pre_tokenizer"] != {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocab = described["model"]["vocab"]
    special = {t["content"] for t in described["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in described["model"]["merges"]]
    ids = [vocab[a + b] for a, b in merges]
    if len(ids) + 256 != len(ranks) or ids != sorted(ids) or len(set(ids)) != len(ids):
        return None
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_kept: dict = {}


def worker_tokens(path: str) -> Tokens:
    """The tokenizer of this worker process."""
    if path not in _kept:
        _kept[path] = Tokens(path)
    return _kept[path]


def worker_lengths(path: str, frequent: dict[str, int]) -> Lengths:
    """The lookup of this worker process, made anew for another table."""
    held = _kept.get("lengths")
    if held is None or held.tokens is not worker_tokens(path) or held.frequent is not frequent:
        _kept["lengths"] = held = Lengths(worker_tokens(path), frequent)
    return held
