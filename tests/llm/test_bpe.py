import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from cellwatch.llm import bpe
from llm_edges import EDGES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LINES = open(PATH, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, LINES.splitlines())}
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_encoding_equals_the_library_on_odd_texts():
    random.seed(1)
    pool = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2030), 0x3000, 0x1F600, 0x660, 0x85, 0x180E]]
    codec = bpe.codec(LINES, public_tokenizers.PATTERN)
    for _ in range(3000):
        text = "".join(random.choice(pool if random.random() < 0.3 else "abthe  \n\t'sTt12") for _ in range(random.randint(0, 60)))
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(i).encode() for i in range(5000)]
    made = bpe.PerfectHash(keys)
    assert sorted(made.find(k) for k in keys) == list(range(5000))
    assert made.find(b"none") == -1 and bpe.PerfectHash([]).find(b"x") == -1
    assert bpe.PerfectHash(keys, made.seeds).slots == made.slots


def test_edges(edges, nothing):
    for row in bpe.digests(edges).collect():
        text = next(t for d, t in EDGES if d == row["doc_id"]) or ""
        ids = REFERENCE.encode_ordinary(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(nothing).count() == 0
    assert bpe.encode(edges, PATH, public_tokenizers.PATTERN).schema["token_ids"].dataType.simpleString() == "binary"


