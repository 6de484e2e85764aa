import duckdb

from cellwatch.llm import perspectives

SCHEMA = "conv_id long, turn long, role string, text string, speaker string, mask string"
TURNS = [
    (1, 0, "system", "be kind"),
    (1, 1, "ann", "hi <|im_end|>"),
    (1, 2, "bob", "\U0001f600 hello"),
    (1, 2, "bob", "\U0001f600 hello"),
    (1, 300, "cy", None),
    (2, 0, None, "no name"),
    (2, 1, "  ", "no name either"),
    (2, None, "ann", "when?"),
    (3, 0, "system", "alone"),
    (None, 0, "ann", "nowhere"),
    (None, 0, "ann", "nowhere else"),
]


def check(row):
    """Masks name the assistant's texts, counted from the beginning of the dialogue."""
    spans = [tuple(map(int, s.split(":"))) for s in row["mask"].split(",") if s]
    assert len(spans) == row["n_assistant"]
    for a, b in ((a - row["start"], b - row["start"]) for a, b in spans):
        assert row["rendered"][:a].endswith("<|im_start|>assistant\n") and row["rendered"][a:b].endswith("<|im_end|>\n")
        assert row["rendered"][a:b].count("<|") == 1
    assert row["rendered"].count("<|im_start|>assistant") == len(spans)


def test_masks_cover_the_texts_of_the_assistant(spark):
    df = spark.createDataFrame([(*t, "old", "old") for t in TURNS], SCHEMA)
    rows = perspectives.rotate(df).collect()
    seen = sorted((str(r["conv_id"]), r["segment"], r["speaker"]) for r in rows)
    assert seen == [("1", 0, "ann"), ("1", 0, "bob"), ("1", 0, "cy"), ("2", 0, "ann"), ("2", 0, "unknown"), ("None", 0, "ann"), ("None", 0, "ann")]
    for row in rows:
        check(row)
    bob = next(r for r in rows if (r["conv_id"], r["speaker"]) == (1, "bob"))
    # What is said twice is rendered twice.
    assert bob["rendered"] == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi < |im_end|><|im_end|>\n"
        "<|im_start|>assistant\n\U0001f600 hello<|im_end|>\n<|im_start|>assistant\n\U0001f600 hello<|im_end|>\n<|im_start|>user name=cy\n<|im_end|>\n"
    )
    assert (bob["n_turns"], bob["n_assistant"]) == (5, 2)
    assert perspectives.rotate(df.limit(0)).count() == 0


def long_conversation():
    names = ["system", "ann", "bob", "cy"]
    return [(9, i, names[i % 4] if i else "system", f"turn {i} " + "x" * (i % 50)) for i in range(1500)] + [(8, 0, "ann", "y" * 200_000)]


def test_long_conversations_are_whole_and_pieces_join_to_them(spark):
    df = spark.createDataFrame(TURNS + long_conversation(), "conv_id long, turn long, role string, text string").repartition(5)
    whole = {(r["conv_id"], r["speaker"], r["rendered"]): r for r in perspectives.rotate(df).collect()}
    assert {r["n_turns"] for r in whole.values() if r["conv_id"] == 9} == {1500}
    pieces = {}
    for r in perspectives.rotate(df, 7).collect():
        check(r)
        pieces.setdefault((r["conv_id"], r["speaker"], r["rendered"] if r["conv_id"] is None else None), []).append(r)
    assert len(pieces) == len({(c, s, t if c is None else None) for c, s, t in whole})
    for (conv, speaker, _), parts in pieces.items():
        parts.sort(key=lambda r: r["segment"])
        text = "".join(r["rendered"] for r in parts)
        row = whole[conv, speaker, text]
        assert ",".join(r["mask"] for r in parts if r["mask"]) == row["mask"]
        at = 0
        for r in parts:
            assert r["start"] == at and r["n_turns"] <= 7
            at += len(r["rendered"])


def test_rotation_equals_its_sql(spark, tmp_path):
    turns = TURNS + [TURNS[-1]] + long_conversation()
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    names = ["conv_id", "segment", "speaker", "n_turns", "n_assistant", "start", "rendered", "mask"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({perspectives.SQL})").fetchall()
    got = [tuple(r) for r in perspectives.rotate(df).select(*names).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
