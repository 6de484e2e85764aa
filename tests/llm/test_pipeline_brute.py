"""The whole pipeline against plain Python, and its stages on odd tables."""

import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from llm_edges import CLASHING, EDGES, EXTRA

import corpus_pipeline
from cellwatch.llm import common

COLUMNS = "score predicted kept n_lines n_deleted deleted items spans n_words n_hit contaminated node mark __kept rank text_sha256"


def folder(spark, path, docs, schema, labels=(), benchmark=()):
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def lines_left(docs):
    """Texts less later copies of runs of ten words, and without documents of which nothing is left."""
    seen, out = set(), []
    for doc_id, text in docs:
        lines = [(at, line) for at, line in enumerate((text or "").split("\n")) if line.strip()]
        gone = set()
        for begin in range(len(lines)):
            for end in range(begin, len(lines)):
                run = tuple(line for _, line in lines[begin : end + 1])
                if sum(len(line.split()) for line in run) >= 10:
                    if run in seen:
                        gone |= {at for at, _ in lines[begin : end + 1]}
                    seen.add(run)
        if not gone or len(gone) < len(lines):
            out.append((doc_id, text if not gone else "\n".join(line for at, line in enumerate(text.split("\n")) if at not in gone)))
    return out


def one_of_each(docs):
    sets = {}
    for doc_id, text in docs:
        words = common.lower_words(text)
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return [(i, t) for i, t in docs if top(i) == i]


def clean(docs, benchmark, window=13):
    out = []
    for doc_id, text in docs:
        words, hit = common.alnum_words(text), set()
        for _, item in benchmark:
            own = common.alnum_words(item)
            size = min(window, len(own))
            for i in range(len(own) - size + 1 if own else 0):
                for j in range(len(words) - size + 1):
                    if words[j : j + size] == own[i : i + size]:
                        hit |= set(range(j, j + size))
        if not hit or 20 * len(hit) < len(words):
            out.append((doc_id, text))
    return out


def test_run_equals_plain_python(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    shared = [" ".join(word() for _ in range(rng.randint(4, 9))) for _ in range(6)]
    exam = " ".join(word() for _ in range(30))
    docs = []
    for _ in range(60):
        lines = [" ".join(word() for _ in range(rng.randint(3, 14))) for _ in range(rng.randint(1, 6))]
        for at in rng.sample(range(len(lines) + 1), rng.randint(0, 1)):
            lines[at:at] = shared[: rng.randint(1, 6)]
        docs.append("\n".join(lines))
    docs += ["\n".join(shared), "\n".join(shared[:3]), "", None, " \n "]
    docs += [docs[i].replace("a", "A", 2) for i in (1, 5, 9)]  # equal but for case, so no line is
    docs += [" ".join([*(word() for _ in range(10)), exam[20:120], *(word() for _ in range(10))]), " ".join([*(word() for _ in range(900)), exam])]
    near = [word() for _ in range(80)]
    docs += [" ".join(near), " ".join([*near[:40], "changed", *near[41:]])]
    rows = list(enumerate(docs))
    benchmark = [(1, exam), (2, None), (None, " ".join(word() for _ in range(20)))]
    path = folder(spark, tmp_path / "sf", rows, "doc_id long, text string", benchmark=benchmark)
    kept = clean(one_of_each(lines_left(rows)), benchmark)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines())}
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text in kept:
        ids = encoder.encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    found = corpus_pipeline.run(spark, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(want)
    assert 40 < len(want) < len(docs)


def test_columns_of_any_name_stay_as_they_are(spark, tmp_path):
    names = COLUMNS.split()
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    rows = [(i, f"a text of its own, number {i} and {i * 7} of many", 5, *[f"{c}-{i}" for c in names]) for i in range(12)]
    path = folder(spark, tmp_path / "sf", rows, schema, [(i, 1, 0) for i in range(12)], [(1, "nothing like it in any of these documents, not even one")])
    docs = common.table(spark, path, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, path)
        assert kept.columns == docs.columns, name
        assert sorted(map(tuple, kept.collect())) == rows, name


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(*row, *["old"] * len(EXTRA)) for row in EDGES]
    path = folder(spark, tmp_path / "sf", rows, CLASHING, [(None, 1, 1), (1, None, None), (6, 0, 1)], [(None, None), (1, "")])
    docs = common.table(spark, path, "documents")
    wanted = {"toxicity": [1, 2, 2, 3, 4, 5, 6, 7, 8], "line_dedup": [1, 3, 4, 5, 6, 7, 8], "simhash_near_dedup": [1, 3, 6, 7, 8], "decontamination": [1, 3, 6, 7, 8]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        found = docs.collect()
        assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == wanted[name] or name == "toxicity"
        assert sum(r["doc_id"] is None for r in found) == 1 and all(r["kept"] == "old" for r in found)
    assert corpus_pipeline.encode(spark, docs, path).count() == len(found)
