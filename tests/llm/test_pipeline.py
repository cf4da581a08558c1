"""The stages in order, against what each must do with rows made for it, and the guard of the entry."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.texts import words

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Documents before and after each stage but the last, and the packed result."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 120").orderBy("item_id").first().text
    base = docs.where("lang = 'en' AND n_chars > 900").orderBy("doc_id").first().text
    extra = [
        (100_001, None), (100_002, "123 456"), (100_003, base), (100_004, "Another start. " + base + " And an end."),
        (100_005, "The words of this " + item + " and of that"), (100_006, "And the one to ask is ann.lee@mail.example.org or 10.20.30.40, said the other."),
        (100_007, ""), (None, "The text that has no id but is of the language and with words"),
    ]
    more = spark.createDataFrame(extra, "doc_id long, text string").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "'src0' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    steps = [docs.unionByName(more).cache()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], sf).cache())
    return steps, corpus_pipeline.STAGES[-1][1](spark, steps[-1], sf)


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(stages):
    steps, packed = stages
    start, language, unique, clean, private = steps
    assert all(s.columns == start.columns for s in steps)
    assert {100_001, 100_002, 100_007} == ids(start) - ids(language)
    assert {100_003, 100_004} & ids(unique) == set() and {100_005, 100_006, None} <= ids(unique)
    assert 100_005 not in ids(clean) and {100_006, None} <= ids(clean)
    assert ids(private) == ids(clean) and private.count() == clean.count()
    text = private.where("doc_id = 100006").first()
    assert "ann.lee" not in text.text and "10.20.30.40" not in text.text and len(words(text.text)) == 12 and text.n_chars == len(text.text)
    rows = packed.collect()
    assert {r.doc_id for r in rows} == ids(private)
    bins = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert sum(n for _, n in held) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:]))


def test_near_duplicates_by_brute_force(stages):
    from tests.llm.test_pairs import components

    steps, _ = stages
    rows = [(r.doc_id, r.text) for r in steps[1].select("doc_id", "text").collect()]
    want = {v[1] for i, v in components(rows, 5, 80).items() if i is not None}
    assert ids(steps[2]) - {None} == want


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert sum(name.startswith("op") and name[2].isdigit() for name in entry.queries()) == 10


def test_entry_without_these_folders(tmp_path):
    for name in ("catalog", "__spark_entry__.py"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "tidemark")
    for name in os.listdir(f"{ROOT}/tidemark"):
        if name != "llm":
            os.symlink(f"{ROOT}/tidemark/{name}", tmp_path / "tidemark" / name)
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}]; exec(open({str(tmp_path / '__spark_entry__.py')!r}).read().replace('os.path.abspath(__file__)', repr({str(tmp_path / 'x')!r})), d := {{'__name__': 'e'}}); q = d['queries'](); print(len(q), [n for n in q if n.startswith('op1') or n == 'pipeline'])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-500:]
    n, names = done.stdout.split(" ", 1)
    assert int(n) >= 116 and names.strip() == "[]"
