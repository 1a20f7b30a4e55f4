"""Byte-level BPE vocabularies: loading, splitting into pre-tokens and encoding one pre-token.

A vocabulary file is read on the driver and broadcast; its size is that of the file, which doesn't grow with
the data.  ``tiktoken`` does the merges (its core takes one pre-token at a time), ``tokenizers`` is the
authority for ``.json`` files: texts with characters outside the plain ranges go to it whole.
"""

from __future__ import annotations

import base64
import functools
import json
from dataclasses import dataclass

from .common import process_cache, ship

ship(__name__)

#: The pre-token pattern of the rank files, and the same for Python's re over plain characters.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
#: Characters for which both patterns (and the engines' Unicode tables) provably agree; others take the slow way.
UNPLAIN = "[^\\t-\\r\\x20-\\x7e\\xa0-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]"
#: White space as the Unicode property has it; Python's \s also takes the separators U+001C to U+001F.
WHITE = r"\t-\r\x20\x85\xa0  -     　"


@dataclass(frozen=True)
class VocabFile:
    """The bytes of a vocabulary file with its kind."""

    kind: str  # "json" or "ranks"
    data: bytes
    key: str

    @classmethod
    def load(cls, path: str) -> "VocabFile":
        import zlib

        with open(path, "rb") as f:
            data = f.read()
        return cls("json" if path.endswith(".json") else "ranks", data, f"vocab-{zlib.crc32(data)}-{len(data)}")

    def plain(self) -> tuple[str, bytes, str]:
        """What a broadcast carries: executors need not have this class."""
        return self.kind, self.data, self.key


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in .json vocabularies: printable bytes stand for themselves, the
    rest take the code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(vocab: VocabFile) -> dict[bytes, int]:
    if vocab.kind == "ranks":
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocab.data.splitlines()) if a}
    letters = byte_letters()
    model = json.loads(vocab.data)["model"]
    return {bytes(letters[c] for c in s): i for s, i in model["vocab"].items()}


class Codec:
    """Splits, encodes and decodes by one vocabulary.  Built once a Python process."""

    def __init__(self, vocab: VocabFile):
        import re

        import regex
        import tiktoken

        self.ranks = ranks_of(vocab)
        self.special: dict[str, int] = {}
        self.json = vocab.data.decode() if vocab.kind == "json" else None
        #: Whether merging by rank gives the library's ids; if not, the library encodes every text.
        self.by_ranks = vocab.kind == "ranks" or ranks_are_merges(vocab)
        if vocab.kind == "json":
            self.special = {t["content"]: t["id"] for t in json.loads(vocab.data)["added_tokens"]}
        self.engine = tiktoken.Encoding(vocab.key, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.piece = self.engine._core_bpe.encode_single_piece
        self.unplain = re.compile(UNPLAIN).search
        self.special_in = re.compile("|".join(map(re.escape, self.special))).search if self.special else lambda _: None
        self.split_plain = re.compile(PLAIN_PATTERN).findall
        self.split_any = regex.compile(PATTERN.replace(r"[^\s\p", rf"[^{WHITE}\p").replace(r"\s+(?!\S)|\s+", rf"[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")).findall

    @classmethod
    def of(cls, vocab: VocabFile) -> "Codec":
        return process_cache(vocab.key, lambda: cls(vocab))

    @functools.cached_property
    def library(self):
        """The library's own tokenizer, loaded when the first odd text comes."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.json)

    def split(self, text: str) -> list[str]:
        return self.split_any(text) if self.unplain(text) else self.split_plain(text)

    def odd(self, text: str) -> bool:
        """Whether the library itself has to encode this text: special strings, characters beyond the plain, or a
        vocabulary whose ranks aren't its merges."""
        return self.json is not None and bool(not self.by_ranks or self.unplain(text) or self.special_in(text))

    def ids(self, text: str):
        """The ids of a whole text as unsigned 32-bit numbers."""
        import numpy as np

        if self.odd(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.engine.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    def token_bytes(self) -> list[bytes]:
        """Bytes by id; the table that decoding joins, as long as the vocabulary."""
        table = [b""] * (max([*self.ranks.values(), *self.special.values()]) + 1)
        for b, i in self.ranks.items():
            table[i] = b
        for s, i in self.special.items():
            table[i] = s.encode()
        return table


def ranks_are_merges(vocab: VocabFile) -> bool:
    """Whether a .json vocabulary is plain byte-level BPE, split by the pattern above, that numbers its tokens in the
    order of its merges, so that ranks stand for merges."""
    file = json.loads(vocab.data)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or file.get("normalizer") or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    of_bytes = [model["vocab"].get(c) for c in byte_letters()]
    special = {t["content"] for t in file["added_tokens"]}
    rest = len([t for t in model["vocab"] if t not in special])
    return None not in of_bytes and made == sorted(set(made)) and max(of_bytes) < made[0] and len(made) + 256 == rest


def whole_tokens(vocab: VocabFile) -> set[str]:
    """The vocabulary strings that encode alone as one token and split alone as one pre-token: for a pre-token
    among them the count is 1, whatever stands around it.  Proved string by string with the vocabulary's own
    library."""
    codec = Codec.of(vocab)
    texts = {}
    for b, i in codec.ranks.items():
        try:
            texts[b.decode()] = i
        except UnicodeDecodeError:
            continue
    names = [t for t in texts if not codec.odd(t) and codec.split(t) == [t]]
    if codec.json is not None:
        coded = [e.ids for e in codec.library.encode_batch_fast(names, add_special_tokens=False)]
    else:
        coded = [codec.piece(t.encode()) for t in names]
    return {t for t, ids in zip(names, coded) if ids == [texts[t]]}
