"""The pipeline stage by stage against brute force on a small folder of tables."""

import corpus_pipeline
import pytest
from test_operators import brute_contamination, brute_groups, brute_mix

from gearledger.llm.common import prepare


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The rows after each stage, each read from what the one before it wrote."""
    prepare(spark)
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    base = tmp_path_factory.mktemp("stages")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        path = str(base / str(number))
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def rows(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_quality_rejects_some(stages, spark, folder):
    before, after = {r[0] for r in rows(stages[0])}, {r[0] for r in rows(stages[1])}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    gone = before - after
    good = [d for d in before if labels.get(d) == 1]
    assert after < before and len([d for d in good if d in gone]) <= 0.05 * len(good)


def test_one_of_each_group_stays(stages):
    kept = rows(stages[1])
    sets, root = brute_groups(kept)
    least = {}
    for r, s, x in zip(kept, sets, root):
        if s:
            least[x] = min(least.get(x, r[0]), r[0])
    assert sorted(r[0] for r in rows(stages[2])) == sorted([*least.values(), *[r[0] for r, s in zip(kept, sets) if not s]])


def test_contaminated_documents_go(stages, spark, folder):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = [r[0] for r in brute_contamination(rows(stages[2]), items) if not r[-1]]
    assert sorted(r[0] for r in rows(stages[3])) == sorted(want)


def test_the_mix_repeats_documents(stages):
    kept = rows(stages[3])
    times = [r[4] // r[1] if r[1] else None for r in brute_mix(kept)]
    mixed = [r[0] for r in rows(stages[4])]
    for r, n in zip(kept, times):
        assert n is None or mixed.count(r[0]) == n


def test_the_files_hold_the_mix(stages):
    tokens = stages[5].orderBy("start").collect()
    assert [t.doc_id for t in tokens] == sorted(r[0] for r in rows(stages[4]))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(tokens, tokens[1:]))


def test_run_equals_the_stages(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[5].select(*got.columns).collect()))
