import public_tokenizers
from cellwatch.llm import bpe, common, decontaminate, line_runs
from cellwatch.runtime import materialize

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_keeps_the_columns_and_drops_what_it_should(spark):
    docs = common.table(spark, FOLDER, "documents")
    columns, steps = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(materialize(stage(spark, steps[-1], FOLDER), name))
        assert steps[-1].columns == columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]
    counts = [s.count() for s in steps]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    # Nothing is left for a second run of the exact stages.
    assert line_runs.dedupe_lines(steps[2]).where("n_deleted > 0").count() == 0
    assert decontaminate.decontaminate(steps[4], common.table(spark, FOLDER, "benchmark")).where("contaminated").count() == 0
    last = corpus_pipeline.encode(spark, steps[4], FOLDER)
    assert last.count() == counts[-1]
    packed = bpe.encode(steps[4], public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert packed.where("decoded <> cast(coalesce(text, '') AS binary)").count() == 0


def test_stages_take_an_empty_table(spark):
    docs = common.table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
