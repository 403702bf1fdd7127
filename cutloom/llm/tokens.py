"""Encoding of a corpus with a public byte-level BPE vocabulary, with reuse of content-defined chunks."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; a parameter of every function here.
VOCABULARY = os.environ.get("CUTLOOM_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The vocabulary's splitting pattern, a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters in the rolling window, mean and least characters of a chunk, chunks a task remembers.
WINDOW, MEAN_CHUNK, LEAST_CHUNK, REMEMBERED = 24, 256, 64, 20_000

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
SAFE = re.compile(r"(?<=\S)[ \n]")


def encoder(path: str):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class ChunkEncoder:
    """Exact ids of texts; a chunk that occurs again, in any text, is not encoded again.

    Chunk ends are set where a rolling hash over the last characters has zero low bits, so equal passages give equal
    chunks wherever they stand. Inside a chunk, a blank after a printing character always starts a new piece of the
    splitting pattern, whatever stands around the chunk; between the first and the last such place the chunk's ids are
    final. What lies between two chunks' final parts is encoded once more as one string, which repairs the join exactly.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.encode = encoder(path).encode_ordinary
        self.known: dict[str, tuple[str, np.ndarray, str] | None] = {}
        self.remembered = remembered
        self.encoded = self.reused = 0
        self._powers(1 << 14)

    def _powers(self, n: int) -> None:
        up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def cuts(self, text: str) -> list[int]:
        """The ends of the text's chunks; the last is the text's length."""
        n = len(text)
        if n <= LEAST_CHUNK + WINDOW:
            return [n]
        if n > len(self.up):
            self._powers(2 * n)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        total = np.cumsum(codes * self.down[:n], dtype=np.uint64)
        total[WINDOW:] -= total[:-WINDOW].copy()
        mixed = (total * self.up[:n]) >> np.uint64(40)
        places = np.nonzero((mixed[WINDOW:] & np.uint64(MEAN_CHUNK - 1)) == 0)[0] + WINDOW + 1
        out, last = [], 0
        for p in places.tolist():
            if p - last >= LEAST_CHUNK:
                out.append(p)
                last = p
        return out if last == n else [*out, n]

    def parts(self, chunk: str) -> tuple[str, np.ndarray, str] | None:
        """Open head, ids of the final part, open tail; None where the chunk has no final part."""
        if chunk in self.known:
            self.reused += 1
            return self.known[chunk]
        self.encoded += 1
        first = SAFE.search(chunk)
        made = None
        if first:
            q = first.start()
            p = max(chunk.rfind(" "), chunk.rfind("\n"))
            while p > q and chunk[p - 1].isspace():
                p = max(chunk.rfind(" ", 0, p), chunk.rfind("\n", 0, p))
            if p > q:
                made = chunk[:q], np.array(self.encode(chunk[q:p]), np.int32), chunk[p:]
        if len(self.known) >= self.remembered:
            for old in list(self.known)[: self.remembered // 2]:
                del self.known[old]
        self.known[chunk] = made
        return made

    def ids(self, text: str | None) -> list[np.ndarray]:
        if not text:
            return []
        out, seam, last = [], "", 0
        for cut in self.cuts(text):
            chunk, last = text[last:cut], cut
            made = self.parts(chunk)
            if made is None:
                seam += chunk
                continue
            out.append(np.array(self.encode(seam + made[0]), np.int32))
            out.append(made[1])
            seam = made[2]
        out.append(np.array(self.encode(seam), np.int32))
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """One row per row of df: the key and ids (array<int>) of the text as it stands, without special tokens.

    Null and empty texts give an empty list; white space alone is encoded. Repeated rows are encoded each. Nothing is
    shuffled: every task encodes a chunk once and remembers it (at most REMEMBERED chunks), so a chunk that a third of
    all texts share costs one encoding a task and never meets in one place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, ChunkEncoder(path))
        for batch in batches:
            found = [coder.ids(t) for t in batch.column(1).to_pylist()]
            sizes = np.array([sum(map(len, x)) for x in found], np.int64)
            flat = np.concatenate([np.empty(0, np.int32), *(y for x in found for y in x)])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
