"""Operator 4: byte-level BPE encoding and decoding with a two-tier lookup.

A minimal perfect hash resolves pre-tokens that are vocabulary entries; others
are merged by a heap over linked bytes. Ranks, split pattern and results are
those of the public rank file read by tiktoken, without special tokens.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwatch.llm import common

# Strings a worker remembers with their ids, in each of two generations of two memories.
REMEMBERED = 200_000
# Longer strings are not remembered, which bounds the memory of a worker.
REMEMBERED_CHARS = 64
_BUCKET = 4


class PerfectHash:
    """Minimal perfect hash from n distinct byte strings to 0..n-1.

    Keys fall into buckets; large buckets first, each looks for a seed that
    puts all its keys on free slots. A bucket of one key names its slot.
    """

    def __init__(self, keys: list[bytes], seeds: list[int] | None = None):
        """With the `seeds` of an earlier build over the same keys, slots are only filled in."""
        self.n = len(keys)
        self.buckets = max(1, -(-self.n // _BUCKET))
        self.slots: list[bytes | None] = [None] * self.n
        if seeds is not None:
            self.seeds = seeds
            for key in keys:
                self.slots[self._slot(key)] = key
            return
        self.seeds = [0] * self.buckets
        held: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for key in keys:
            held[xxhash.xxh64_intdigest(key) % self.buckets].append(key)
        free = self.n - 1
        for bucket in sorted(range(self.buckets), key=lambda b: -len(held[b])):
            if not held[bucket]:
                break
            if len(held[bucket]) == 1:  # any free slot does; the seed names it
                while self.slots[free] is not None:
                    free -= 1
                self.seeds[bucket] = -free - 1
                self.slots[free] = held[bucket][0]
                continue
            seed = 1
            while True:
                places = {xxhash.xxh64_intdigest(k, seed) % self.n for k in held[bucket]}
                if len(places) == len(held[bucket]) and all(self.slots[p] is None for p in places):
                    break
                seed += 1
            self.seeds[bucket] = seed
            for key in held[bucket]:
                self.slots[xxhash.xxh64_intdigest(key, seed) % self.n] = key

    def _slot(self, key: bytes) -> int:
        seed = self.seeds[xxhash.xxh64_intdigest(key) % self.buckets]
        return xxhash.xxh64_intdigest(key, seed) % self.n if seed >= 0 else -seed - 1

    def find(self, key: bytes) -> int:
        """Slot of a key, -1 for a string that is none."""
        if not self.n:
            return -1
        slot = self._slot(key)
        return slot if self.slots[slot] == key else -1


class Memory:
    """Recently used strings and their ids; a full generation replaces the older one."""

    def __init__(self):
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def put(self, key: str, packed: bytes) -> bytes:
        if len(key) <= REMEMBERED_CHARS:
            if len(self.recent) >= REMEMBERED:
                self.older, self.recent = self.recent, {}
            self.recent[key] = packed
        return packed


class Codec:
    """Encoder and decoder of one vocabulary of ranks; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, seeds: list[int] | None = None):
        self.split = regex.compile(pattern).findall
        # A space between two other visible characters always begins a pre-token of this pattern.
        self.parts_at_spaces = pattern == public_tokenizers.PATTERN
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.hash = PerfectHash(list(ranks), seeds)
        self.rank_of_slot = [ranks[key] for key in self.hash.slots]
        self.bytes = [ranks.get(bytes([b])) for b in range(256)]
        self.base = max(ranks.values(), default=0) + 1
        # Every way to put two entries together to a third.
        self.pairs = {
            ranks[token[:cut]] * self.base + ranks[token[cut:]]: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }
        self.chunks, self.pieces = Memory(), Memory()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.parts_at_spaces:
            return self._encode_chunk(text)
        parts = text.split(" ")
        get, out, held = self.chunks.recent.get, [], parts[0]
        for part in parts[1:]:
            # Split only where both neighbours of the space are visible.
            if part and held and not part[0].isspace() and not held[-1].isspace():
                out.append(get(held) or self._encode_chunk(held))
                held = " " + part
            else:
                held += " " + part
        out.append(get(held) or self._encode_chunk(held))
        return b"".join(out)

    def _encode_chunk(self, chunk: str) -> bytes:
        packed = self.chunks.older.get(chunk)
        if packed is None:
            get = self.pieces.recent.get
            packed = b"".join([get(piece) or self._encode_piece(piece) for piece in self.split(chunk)])
        return self.chunks.put(chunk, packed)

    def _encode_piece(self, piece: str) -> bytes:
        packed = self.pieces.older.get(piece)
        if packed is None:
            data = piece.encode()
            slot = self.hash.find(data)
            ids = array("I", [self.rank_of_slot[slot]] if slot >= 0 else self._merge(data))
            if sys.byteorder == "big":
                ids.byteswap()
            packed = ids.tobytes()
        return self.pieces.put(piece, packed)

    def _merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties, over linked parts that begin as bytes.

        A heap entry packs the rank and the place of the left part; it is
        outdated if the parts now there no longer merge to that rank.
        """
        n, base, pair = len(data), self.base, self.pairs.get
        ids = list(map(self.bytes.__getitem__, data))
        bits = n.bit_length()
        low = (1 << bits) - 1
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r << bits) | i for i in range(n - 1) if (r := pair(ids[i] * base + ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & low
            left, j = ids[i], after[i]
            if left is None or j >= n or pair(left * base + ids[j]) != entry >> bits:
                continue
            ids[i] = own = entry >> bits
            ids[j] = None
            after[i] = end = after[j]
            if end < n:
                before[end] = i
                if (r := pair(own * base + ids[end])) is not None:
                    heappush(heap, (r << bits) | i)
            p = before[i]
            if p >= 0 and (r := pair(ids[p] * base + own)) is not None:
                heappush(heap, (r << bits) | p)
        return [x for x in ids if x is not None]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def codec(rank_lines: bytes, pattern: str, seeds: list[int] | None = None) -> Codec:
    """This process's codec of a vocabulary, built once."""
    name = hashlib.sha256(rank_lines + pattern.encode()).hexdigest()
    if name not in _CODECS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_lines.splitlines())}
        _CODECS[name] = Codec(ranks, pattern, seeds)
    return _CODECS[name]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """All columns of `docs`, plus `ids` (binary, little-endian unsigned 32 bit) and `decoded` (binary).

    `path` names the rank file, read on the driver and broadcast: its size is
    that of a vocabulary. Null and empty texts have no ids and decode to
    nothing. Columns of `docs` with the names of the new ones are replaced.
    Rows are independent: nothing is shuffled.
    """
    common.ship(docs.sparkSession)
    with open(path, "rb") as file:
        lines = file.read()
    vocabulary = docs.sparkSession.sparkContext.broadcast((lines, pattern, codec(lines, pattern).hash.seeds))
    kept = [c for c in docs.columns if c not in (ids, "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + f", `{ids}` binary, decoded binary"
    where = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*vocabulary.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            encoded = [own.encode(x) for x in batch.column(where).to_pylist()]
            decoded = [own.decode(x) for x in encoded]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(encoded, pa.binary()), pa.array(decoded, pa.binary())], [*kept, ids, "decoded"]
            )

    return docs.select(*kept).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the decoded bytes."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        F.floor(F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
