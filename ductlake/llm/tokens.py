"""Token ids of a text by a tokenizer file, with a memory of the pieces already seen.

A byte-pair tokenizer first splits a text into pieces and then merges inside each piece, so the ids of
a text are the ids of its pieces one after another.  `Encoder` splits plain Latin texts with the same
pattern, remembers the ids of each piece as bytes and joins them; the tokenizers library computes the
ids of every piece that is not remembered.  All other texts (other scripts, control characters,
combining marks, the strings of special tokens) go to the library whole.  The result is the library's in both cases.

The split patterns are those of two kinds of files, told by the file's own sections (`KNOWN`); every text of any
other file goes to the library.
"""

from __future__ import annotations

import json
import re
import struct

from ductlake.llm.work import hold

# The letters and numbers below U+0250, by the Unicode general categories L and N.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
# The split patterns of the two tokenizer files, over those letters and numbers.
PIECES = {
    "bytes": rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+",
    "words": rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+",
}
# What a file of each kind says of its normalizer, split and model (the model without its tables).
_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
KNOWN = {
    "bytes": (None, {**_LEVEL, "use_regex": True}, {"end_of_word_suffix": None}),
    "words": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {**_LEVEL, "use_regex": False}]},
        {"end_of_word_suffix": "</w>"},
    ),
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
# Outside this range the whole text goes to the library (U+0130 has a lower case of two letters).
NOT_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u012f\\u0131-\\u024f]")

# Pieces remembered per worker (some 300 MB at most); the memory starts anew beyond it, results do not depend on it.
MAX_PIECES = 1_200_000
MAX_PIECE_LETTERS = 64


def kind_of(content: str) -> str | None:
    """Which of `KNOWN` a tokenizer file is, or None."""
    file = json.loads(content)
    model = {k: v for k, v in file["model"].items() if k not in ("vocab", "merges")}
    found = (file.get("normalizer"), file.get("pre_tokenizer"))
    return next((kind for kind, (normalizer, split, more) in KNOWN.items() if found == (normalizer, split) and model == {**_MODEL, **more}), None)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(0x100 + others.index(b)) for b in range(256)]


class Encoder:
    """`ids(text)`: unsigned 32-bit little-endian ids of a whole text as bytes; null counts as empty."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = file.read()
        self.tokenizer = Tokenizer.from_str(content)
        kind = kind_of(content)
        self.merge = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lower = kind == "words"
        self.pieces = re.compile(PIECES[kind]).findall if kind else None
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.pieces is None or NOT_PLAIN.search(text) or any(s in text for s in self.special):
            return self.library(text)
        known, pieces = self.known, self.pieces(text.lower() if self.lower else text)
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        if len(known) > MAX_PIECES:
            known.clear()
        out = []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= MAX_PIECE_LETTERS:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return hold(("encoder", path), lambda: Encoder(path))
