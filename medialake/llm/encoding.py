"""Exact byte-level BPE ids and lengths of whole texts, by pre-token, with a bounded cache in each worker."""

from __future__ import annotations

import json
import re
from array import array
from functools import cache
from pathlib import Path

import numpy as np

#: Texts with other characters than these are given to the tokenizer whole: tables of Unicode versions may differ.
PLAIN = r"\t\n\r\x20-\x7e\xa0-ɏΑ-ΡΣ-ωА-я‐-‧‰-›€"
#: Letters, digits and white space among them.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-я", "0-9²³¹¼-¾"
#: Fixed value of the vocabulary's file format: its split pattern, with its classes as they are among PLAIN.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+"
#: The same where white space never stands beside white space: nothing looks ahead, so that automata can split whole texts.
SPLIT_SINGLE = rf" ?[{LETTERS}]+| ?[{DIGITS}]+|'(?:[stmd]|re|ve|ll)| ?[^\s{LETTERS}{DIGITS}]+|\s"
#: Pre-tokens in each of the two generations of a worker's cache: about 80 MB together.
CACHED = 200_000
#: Longer pre-tokens aren't cached, so that the bound holds in bytes too.
LONGEST = 64


def _shown() -> dict[int, str]:
    """How byte-level vocabularies show bytes: printable ones as themselves, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


SHOWN = _shown()


class Known(dict):
    """What a function gives for pre-tokens, kept up to the bounds above: a full generation becomes the older one."""

    def __init__(self, find):
        self.find = find
        self.older: dict = {}

    def __missing__(self, piece: str):
        value = self.older.get(piece)
        if value is None:
            value = self.find(piece)
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        if len(piece) <= LONGEST:
            self[piece] = value
        return value


def by_rank(path: str, special: list[str]):
    """The vocabulary as byte ranks, where its merges come in the order of their ids; otherwise None.

    Merging by the least id is then the file's own merging, and tiktoken does it several times as fast. Returns an
    encoding of single pre-tokens and one of texts that SPLIT_SINGLE splits.
    """
    model = json.loads(Path(path).read_text())["model"]
    if model.get("type", "BPE") != "BPE" or not all(c in model["vocab"] for c in SHOWN.values()):
        return None
    merged = [model["vocab"][m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])) or len(merged) + 256 != len(model["vocab"].keys() - set(special)):
        return None
    byte = {ord(c): b for b, c in SHOWN.items()}
    ranks = {bytes(s.translate(byte), "latin-1"): i for s, i in model["vocab"].items() if s not in special}
    import tiktoken

    return tuple(tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) for name, pattern in (("pre-tokens", r"[\s\S]+"), ("texts", SPLIT_SINGLE)))


class Encoder:
    """Encodes texts as the tokenizers library does with one vocabulary file, without added special tokens.

    Texts without runs of white space go to tiktoken whole, where it has the vocabulary. In others each pre-token is
    encoded once and kept. Texts with special strings or rare characters go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split, self.odd = re.compile(SPLIT).findall, re.compile(f"[^{PLAIN}]").search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.runs = re.compile(r"\s\s").search
        self.ranks, self.texts = by_rank(path, self.special) or (None, None)
        self.known = Known(lambda piece: array("I", self.tokens(piece)).tobytes())

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def tokens(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        if self.ranks:
            return self.ranks.encode_ordinary(piece)
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(SHOWN))]

    def plainly(self, text: str) -> bool:
        """Whether the text may be split here rather than by the library."""
        return self.odd(text) is None and not any(s in text for s in self.special)

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if not self.plainly(text):
            return self.whole(text)
        if self.texts and self.runs(text) is None:
            return array("I", self.texts.encode_ordinary(text)).tobytes()
        return b"".join(map(self.known.__getitem__, self.split(text)))


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where this machine keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
