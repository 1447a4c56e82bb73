import os
import shutil
import subprocess
import sys

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_output"]
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in queries()} and "pipeline" in queries()
    assert set(oracle_sql()) <= set(queries())


def test_every_stage_decides(spark, sf_dir, tmp_path):
    from test_decontaminate import brute as leaks
    from test_near_dedup import brute as groups

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, sf_dir)
        if name != "token_output":
            assert out.columns == columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "language_id":
            assert len(ids) >= 0.98 * len(before)
        if name == "near_dedup":
            assert sorted(ids) == sorted({c for _, c in groups(before, 5).values()})
        if name == "decontamination":
            assert sorted(ids) == sorted({i for i, _ in before} - {d for d, _ in leaks(before, items)})
        if name == "token_output":
            assert sorted(ids) == sorted(i for i, _ in before)


def test_the_rest_works_without_the_subpackage(tmp_path):
    for part in ("placerank", "__spark_entry__.py"):
        source = os.path.join(ROOT, part)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
