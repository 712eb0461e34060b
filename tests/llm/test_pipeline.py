import random
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest
from helpers import components, normal
from test_text import check_packing

REPO = Path(__file__).resolve().parents[2]


def corpus(spark, folder):
    """Clean texts in three sources with copies and near copies, and junk of two kinds; labels for some of them."""
    r = random.Random(11)
    word = lambda: "".join(r.choice(["th", "er", "in", "on", "an", "re", "ou", "st"]) for _ in range(r.randint(1, 4)))
    rows, junk = [], set()
    for i in range(500):
        words = [word() for _ in range(r.randint(30, 90))]
        if i % 9 == 0:
            words = [w + "%%%" for w in words] if i % 2 else [w for w in words[:20] for _ in range(6)]
            junk.add(i)
        rows.append((i, " ".join(words), "big" if i % 2 else f"s{i % 6}"))
    clean = [x for x in rows if x[0] not in junk]
    for k in range(40):
        base = r.choice(clean)[1]
        rows.append((1000 + k, base.replace(" ", "  ", 3) if k % 2 else base, "big"))
    for k in range(40):
        words = r.choice(clean)[1].split(" ")
        words[r.randrange(len(words))] = "changed"
        rows.append((2000 + k, " ".join(words), "s0"))
    rows += [(3000, None, "big"), (3001, "", None), (1000, rows[500][1], "big")]
    docs = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i not in junk), 0) for i in range(0, 500, 1) if i % 5 < 3]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return rows, junk


def test_stages_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows, junk = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(x["doc_id"], x["text"], x["source"]) for x in docs.collect()]
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{k}")
        out = spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert out.columns == columns, name
            after = [(x["doc_id"], x["text"], x["source"]) for x in out.collect()]
        if k == 0:
            assert {i for i, _, _ in after} == {i for i, _, _ in rows} - junk and len(after) == len(rows) - len(junk)
        elif k == 1:
            keep = {}
            for i, t, _ in before:
                keep[normal(t)] = min(i, keep.get(normal(t), i))
            assert sorted(i for i, _, _ in after) == sorted(keep.values())
        elif k == 2:
            assert sorted(i for i, _, _ in after) == sorted({i for i, _, c in components(before) if c == i})
        elif k == 3:
            copies = Counter(i for i, _, _ in after)
            assert set(copies) == {i for i, _, _ in before} and max(copies.values()) <= 2
            size = Counter()
            got = Counter()
            for i, t, s in before:
                size[s] += len((t or "").split())
                got[s] += copies[i] * len((t or "").split())
            passes = {s: got[s] / size[s] for s in size if size[s]}
            assert min(passes.values()) == passes["big"] == 1 and 1.1 < max(passes.values()) < 1.3
        else:
            check_packing(before, out.collect(), 2048)
        docs = out


def test_run_is_all_stages(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
    assert got.count() > 300


@pytest.mark.parametrize("left", [False, True])
def test_entry_works_without_this_subpackage(tmp_path, left):
    """Also with the pipeline's module left in place."""
    gone = [".git", "llm", "__pycache__", "spark-warehouse", *([] if left else ["corpus_pipeline.py"])]
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, check=True)
    assert said.stdout.split()[-1] == "False" and int(said.stdout.split()[0]) > 50


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clean_documents_are_kept_without_labels(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).count() == docs.count()


def test_every_query_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
    assert len(corpus_pipeline.STAGES) == 5
