"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 16 bytes cuts a text into chunks wherever its low
bits are zero, so equal passages of different documents are cut alike.  A worker
encodes every distinct chunk once and keeps the ids in a bounded memory.  A
chunk knows its ids only between its first and its last safe cut (a place
before a space or line feed that follows a visible character; no token of the
pre-tokenizer spans it).  Around a join, the text from the last safe cut on the
left to the first on the right is encoded anew and replaces what the two
chunks would give alone; a chunk without a safe cut joins on both sides.  The
result is then exactly what encoding the whole text gives.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesearch.llm.frames import add_columns

WINDOW, CHUNK_BITS = 16, 10          # chunks of about 2**10 bytes
CHUNKS_KEPT = 20_000
LONG_CHUNK = 1 << 14                 # bytes; longer ones are encoded, but not kept
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
# fixed: how byte-level BPE splits text
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_GEAR = np.random.default_rng(2).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of UTF-8 bytes; never inside a character."""
    if not len(data):
        return np.zeros(0, np.int64)
    h = _GEAR[data]
    reach = 1
    while reach < WINDOW:                # h[i] becomes the sum of gear[data[i - j]] << j over the window
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
        reach *= 2
    cut = h >> np.uint32(WINDOW - CHUNK_BITS) & np.uint32((1 << CHUNK_BITS) - 1) == 0
    cut[:-1] &= (data[1:] & 0xC0) != 0x80
    cut[-1] = True
    return np.flatnonzero(cut) + 1


def ranks(path: str) -> dict[bytes, int] | None:
    """Byte-level tokens by id, if the file's merges come in order of the ids
    they make, so that merging by lowest id is the same as by first merge."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocab = model["vocab"]
    if any(vocab.get(c) is None or vocab[c] > 255 for c in byte) or any(vocab.get(x + y) != 256 + k for k, (x, y) in enumerate(merges)):
        return None
    return {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if i < 256 + len(merges)}


def last_cut(text: str) -> int:
    """The last safe cut."""
    p = len(text)
    while True:
        p = max(text.rfind(" ", 0, p), text.rfind("\n", 0, p))
        if p <= 0 or not text[p - 1].isspace():
            return p


class Encoder:
    """Encodes and decodes texts as the tokenizers library does with the file
    at ``path``, without added special tokens, truncation or padding.

    Merging is left to tiktoken, several times as fast, for text of common
    Latin characters, where both libraries split words alike, and to the
    tokenizers library for any other and for special tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.chunks: dict[bytes, tuple[str, np.ndarray | None, str]] = {}
        self.names = [str(i) for i in range(self.lib.get_vocab_size())]
        self.fast = None
        if (known := ranks(path)) is not None:
            import tiktoken
            self.fast = tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=known, special_tokens={})
        special = [re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values()]
        self.slow = re.compile("|".join([r"[^\t\n\r\x20-\x7e\u00a1-\u024f]", *special]))

    def _ids(self, text: str) -> list[int]:
        if self.fast is None or self.slow.search(text):
            return self.lib.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def _chunk(self, c: bytes) -> tuple[str, np.ndarray | None, str]:
        """Head, inner ids and tail; no inner ids where there is no safe cut."""
        if (known := self.chunks.get(c)) is None:
            text = c.decode("utf-8", "surrogatepass")
            if (cut := _CUT.search(text)) is None:
                known = (text, None, "")
            else:
                first, last = cut.start(), last_cut(text)
                known = (text[:first], np.array(self._ids(text[first:last]), np.uint32), text[last:])
            if len(self.chunks) >= CHUNKS_KEPT:
                self.chunks.clear()
            if len(c) <= LONG_CHUNK:
                self.chunks[c] = known
        return known

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            blob = text.encode("utf-8", "surrogatepass")
            ends = chunk_ends(np.frombuffer(blob, np.uint8)).tolist()
            ids: list[int] = []
            joint: list[str] = []        # text between the last safe cut so far and here
            for a, b in zip([0, *ends], ends, strict=False):
                head, inner, tail = self._chunk(blob[a:b])
                joint.append(head)
                if inner is not None:
                    ids += self._ids("".join(joint))
                    ids += inner.tolist()
                    joint = [tail]
            if joint:
                ids += self._ids("".join(joint))
            out.append(ids)
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.lib.decode_batch(ids, skip_special_tokens=False)


@cache
def encoder_of(path: str) -> Encoder:
    """One a worker process, so its tasks share what was encoded."""
    return Encoder(path)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_KINDS = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
          "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}


def encoded(docs: DataFrame, path: str, columns: tuple[str, ...] = ("ids", "decoded"), text: str = "text") -> DataFrame:
    """``docs`` with the asked ones of: ids, decoded, n_tokens, ids_sha256 (of
    the decimal ids joined by commas) and decoded_sha256, in lowercase hex.

    ``path`` names the tokenizer's file on every executor.  A null text counts
    as empty (no ids, decoded empty).  Whole texts of any length are encoded;
    repeated rows give equal results.  Columns of ``docs`` with one of the
    asked names are replaced.
    """
    schema = T.StructType([T.StructField(c, _KINDS[c]) for c in columns])

    def make():
        encoder = encoder_of(path)

        def step(texts):
            ids = encoder.encode([t or "" for t in texts])
            decoded = encoder.decode(ids) if {"decoded", "decoded_sha256"} & set(columns) else []
            have = {"ids": lambda: ids, "decoded": lambda: decoded, "n_tokens": lambda: [len(x) for x in ids],
                    "ids_sha256": lambda: [sha256(",".join(map(encoder.names.__getitem__, x))) for x in ids],
                    "decoded_sha256": lambda: [sha256(x) for x in decoded]}
            return [have[c]() for c in columns]
        return step
    return add_columns(docs.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit(""))), text, schema, make)
