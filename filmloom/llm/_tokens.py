"""Public tokenizers as arrays of ids and the bytes of each id, and the places where a text may be cut before encoding."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

#: Bytes that may end a character of white space; a space behind one of them is no safe place.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[*range(9, 14), *range(28, 33), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
#: The pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass
class Vocabulary:
    """The bytes of id i are ``data[at[i]:at[i + 1]]``."""

    data: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> Vocabulary:
        return Vocabulary(np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64))

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.at[ids + 1] - self.at[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[gathered(self.at[ids], self.sizes(ids))]


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of the ranges [start, start + size), one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a character: itself where that is printable Latin-1, else 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """The ids of a tokenizers file of byte-level BPE.

    Merges are done by tiktoken over the file's own vocabulary, which gives the same ids where every merge makes the next
    id; other files raise a ValueError. ``plain``: strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, plain: bool):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE tokenizer")
        byte, special = _byte_of(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if model["vocab"][a + b] != 256 + k:
                raise ValueError("merges are not in the order of the ids")
        tokens = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for t, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            tokens[i] = t
        self.vocabulary = Vocabulary.of(tokens)
        self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._allowed = set() if plain else set(special)

    def ids(self, text: str) -> np.ndarray:
        return self._bpe.encode_to_numpy(text, allowed_special=self._allowed, disallowed_special=()).astype(np.int32)


class PieceBPE:
    """The ids of a SentencePiece model that puts a space before its text."""

    def __init__(self, path: str):
        import sentencepiece

        self._sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has white space behind other characters")
        self.vocabulary = Vocabulary.of([bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._sp.encode(text), np.int32)


_loaded: dict[tuple, ByteBPE | PieceBPE] = {}


def byte_bpe(path: str, plain: bool = False) -> ByteBPE:
    """A worker's encoder of a file, loaded once."""
    if ("byte", path, plain) not in _loaded:
        _loaded["byte", path, plain] = ByteBPE(path, plain)
    return _loaded["byte", path, plain]


def piece_bpe(path: str) -> PieceBPE:
    if ("piece", path) not in _loaded:
        _loaded["piece", path] = PieceBPE(path)
    return _loaded["piece", path]


def safe_cuts(text: bytes, every: int) -> np.ndarray:
    """Places in a text, at least ``every`` bytes apart, that no tokenizer here joins over: a space behind what is no white space.

    A space there opens a new word for the byte-level pattern, and no piece has white space behind other characters. So the
    ids of the parts, one after another, are those of the text.
    """
    out, at = [], every
    d = np.frombuffer(text, np.uint8)
    while at < len(d):
        window = d[at - 1 : at + every]
        found = np.flatnonzero((window[1:] == 32) & ~_MAYBE_SPACE[window[:-1]])
        if len(found) and at + found[0] < len(d) - 1:  # a lone space at the end is no part of its own
            out.append(at + int(found[0]))
            at = out[-1] + every
        else:
            at += every
    return np.array(out, np.int64)
