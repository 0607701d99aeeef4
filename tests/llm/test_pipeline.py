"""The pipeline against brute force, stage by stage, on a small folder of tables."""

import random

import pytest

import corpus_pipeline
from quillspark.llm import common

from .test_operators import WORD, brute_components, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [(k, " ".join(prose(rng, 30, 3000))) for k in range(5)]
    texts = [" ".join(prose(rng, rng.randrange(60, 160), 4000)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[4] + " more", "short text", None, "", "again and again " * 30]
    texts += [f"{' '.join(prose(rng, 40, 3000))} {t} {' '.join(prose(rng, 40, 3000))}" for _, t in items]
    rows = [(k, t, ["en", "de", "fr"][k % 3], f"src{k % 4}", len(t or "")) for k, t in enumerate(texts)] + [(None, " ".join(prose(rng, 50)), None, None, 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return f"{path}", rows, items


def test_stages(spark, folder):
    path, rows, items = folder
    docs = common.table(spark, path, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = dict(corpus_pipeline.STAGES)
    at = {}
    for name in names[:-1]:
        docs = common.staged(stages[name](spark, docs, path), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        at[name] = [(r.doc_id, r.text) for r in docs.collect()]
    good = {(k, t) for k, t, *_ in rows if len(WORD.findall(t or "")) >= 20 and not (t or "").startswith("again")}
    assert set(at["quality_rules"]) == good and len(at["quality_rules"]) == len(good)
    component = {k: c for (k, _), c in brute_components([x for x in good if x[0] is not None], 5).items()}
    many = [" ".join(f"{x}{k}" for k in range(40)) for x in "abc"]
    rows = [(1, many[0], "s2"), (1, many[0], "s1"), (2, many[1], "s"), (None, many[0] + " more", "s"), (None, many[1] + " more", "s"), (None, many[2], "s"), (None, many[2], "r"), (None, "", "s")]
    nulls = stages["near_duplicates"](spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), path).collect()
    # unrelated documents stay apart though rows without an id are near both; of repeated rows the smallest source stays
    assert sorted((r.doc_id or 0, r.text, r.source) for r in nulls) == sorted([(1, many[0], "s1"), (2, many[1], "s"), (0, many[2], "r"), (0, "", "s")])
    odd = stages["near_duplicates"](spark, spark.createDataFrame([(1, "a b c", 5, "x"), (1, "a b c", 5, "x")], "doc_id long, text string, _id int, _text string"), path).collect()
    assert [tuple(r) for r in odd] == [(1, "a b c", 5, "x")]
    assert {k for k, _ in at["near_duplicates"]} == {k for k, c in component.items() if k == c} | {None}
    leaked = {k for k, t in good if any(x in t for _, x in items)}
    assert {k for k, _ in at["decontamination"]} == {k for k, _ in at["near_duplicates"]} - leaked
    assert set(at["source_mixing"]) <= set(at["decontamination"])
    out = stages[names[-1]](spark, docs, path).collect()
    key = lambda k: -1 if k is None else k
    assert sorted(key(r.doc_id) for r in out) == sorted(key(k) for k, _ in at["source_mixing"])


def test_run_and_empty(spark, folder, tmp_path):
    path, _, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 0
    for name in ("documents", "benchmark"):
        common.table(spark, path, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
