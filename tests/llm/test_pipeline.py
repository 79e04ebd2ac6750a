"""Each stage of the pipeline against a plain version, on its own input."""

import os
import shutil

import numpy as np
import pytest

from sluice.llm import mixing, pii, toxicity
from sluice.plans import scratch

corpus_pipeline = pytest.importorskip("corpus_pipeline")
AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{AT}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, AT).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((name, docs, new))
        docs = new
    return out


def test_columns(steps):
    assert [s[0] for s in steps] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    for name, before, after in steps[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert after.dtypes == before.dtypes


def test_toxicity(spark, steps):
    _, before, after = steps[0]
    model = toxicity.train(before, spark.read.parquet(f"{AT}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(before, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - toxic


def test_near_dedup(steps):
    from tests.llm.test_near_dedup import brute

    _, before, after = steps[1]
    want = {i for i, (_, _, kept) in brute([(r.doc_id, r.text) for r in before.collect()]).items() if kept}
    assert {r.doc_id for r in after.collect()} == want


def test_pii(steps):
    _, before, after = steps[2]
    old, new = ({r.doc_id: r for r in df.collect()} for df in (before, after))
    assert set(old) == set(new)
    for i, r in new.items():
        assert r.n_chars == len(r.text) and len(pii.detect(r.text)) == len(pii.detect(old[i].text))


def test_mixing(steps):
    _, before, after = steps[3]
    want = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == want


def test_packing(steps):
    _, before, after = steps[4]
    rows = after.collect()
    assert sum(r.piece == 0 for r in rows) == before.count()
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


LONG = "word " * 30_000
ROWS = [
    (1, "a plain text of some words that nobody else has " * 3, "en", "web"),
    (1, "a plain text of some words that nobody else has " * 3, "en", "web"),
    (2, None, None, None),
    (3, "", "en", "web"),
    (4, " \n\t ", "en", None),
    (None, "a text without an id, mail me@host.example.org now", "de", "web"),
    (None, None, None, "other"),
    (5, LONG, "en", "other"),
    (6, LONG + "end", "en", "other"),
    (7, "Dr Anna Lopez wrote. Lopez left 4111 1111 1111 1111 behind", None, "other"),
    (2**62, "the last one " * 20, "fr", "web"),
]
EXTRA = ["kinds", "pii_kinds", "place", "cut", "copy", "score", "kept", "node", "component_id", "_row", "size"]


def edges(spark, folder, rows):
    """A table of documents with odd rows and columns whose names the operators use, and labels of some."""
    held = [(i, t, lang, source, len(t or ""), *(f"{c}{k}" for c in EXTRA)) for k, (i, t, lang, source) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    spark.createDataFrame(held, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "none"])
def test_every_stage_and_run_on_edge_cases(spark, tmp_path, rows):
    """No stage fails on nulls, empty and long texts, ties, repeated rows, clashing columns or an empty table."""
    at = edges(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        got = out.collect()
        if name != "packing":
            assert out.columns == docs.columns, name
            # other columns pass as they are
            known = {tuple(r[c] for c in ["doc_id", *EXTRA]) for r in docs.collect()}
            assert all(tuple(r[c] for c in ["doc_id", *EXTRA]) in known for r in got), name
        if name == "toxicity":
            assert len(got) == len(rows)
        if name == "near_dedup" and rows:
            assert {r.doc_id for r in got} == {1, 2, 3, 4, None, 5, 6, 7, 2**62}
        if name == "pii" and rows:
            by = {r.doc_id: r.text for r in got if r.doc_id}
            assert by[2] is None and by[3] == "" and by[5] == LONG and "Lopez" not in by[7] and "4111" not in by[7][5:]
        if name == "packing":
            assert sum(r.piece == 0 for r in got) == docs.count()
        else:
            docs = scratch.keep(out, name)
    ran = corpus_pipeline.run(spark, at)
    places = [(r.sequence_id, r.offset, r.length) for r in ran.collect()]
    assert sum(n for *_, n in places) == sum(r.length for r in got) and len(set(places)) == len(places)


def test_core_without_these_folders(tmp_path):
    """The rest imports, and registers its queries, where this subpackage and the pipeline are absent."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'wordcount' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
