"""Ids of a byte-level BPE tokenizer as bytes.

Where the vocabulary is there as ranks too, plain texts (Latin letters, no control
characters) are encoded from these, several times faster and with the same ids; other texts
go through the library itself. Ids are little-endian 32-bit bytes.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct

#: Beyond Latin letters, and for control characters, the library itself does the work.
PLAIN = re.compile("[\t-\r -\x7e\xa1-\xac\xae-" + chr(0x24F) + "]*\\Z")


def _member(raw: str, name: str) -> list:
    """A list of a JSON object, without reading the vocabulary beside it."""
    at = raw.find(f'"{name}"')
    return json.JSONDecoder().raw_decode(raw, raw.index("[", at))[0] if at >= 0 else []


@functools.lru_cache(maxsize=2)
def ids_bytes(path: str):
    """A function from text to its ids as bytes, equal to the library's encode(text, add_special_tokens=False)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(path, encoding="utf-8") as f:
        special = {t["content"]: struct.pack("<I", t["id"]) for t in _member(f.read(), "added_tokens")}
    splitter = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    @functools.cache
    def library():  # loaded when a text needs it: it takes more memory than all else here
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def whole(text: str) -> bytes:
        ids = library().encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def part(text: str) -> bytes:
        return whole(text)

    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if os.path.exists(ranks):  # the same vocabulary as ranks: the same ids for plain text, several times faster
        import base64

        import tiktoken

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        ordinary = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={}).encode_ordinary

        def part(text: str) -> bytes:
            ids = ordinary(text)
            return struct.pack(f"<{len(ids)}I", *ids)

    def plain(text: str) -> bytes:
        return part(text) if PLAIN.match(text) else whole(text)

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if splitter is not None and "<|" in text and splitter.search(text):
            return b"".join(special[x] if x in special else plain(x) for x in splitter.split(text) if x)
        return plain(text)

    return encode
