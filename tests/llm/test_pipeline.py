"""The pipeline against its stages done by hand, and the entry module with and without it."""

import subprocess
import sys
from pathlib import Path

import brute
import duckdb

ROOT = Path(__file__).resolve().parents[2]


def test_pipeline_against_brute_force(spark, tiny_dir):
    import corpus_pipeline
    from stratiform.llm import quality_rules
    from stratiform.llm.token_pieces import library_tokenizer

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{tiny_dir}/documents.parquet'").fetchall()
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{tiny_dir}/benchmark.parquet'").fetchall()]
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    good = {r.doc_id for r in quality_rules.report(docs).filter("kept").collect()}
    kept = [(d, t) for d, t in rows if d in good]
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: brute.lower(line.strip(blank))
    holders = {}
    for d, t in kept:
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(d)
    kept = [(d, "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == d)) for d, t in kept]
    groups = brute.jaccard_join(kept)
    kept = [(d, t) for d, t in kept if groups[d][1] == d]
    found = [r.asDict() for r in corpus_pipeline.run(spark, tiny_dir).collect()]
    left = {r["doc_id"] for r in found}
    gone = [t for d, t in kept if d not in left]
    assert left <= {d for d, _ in kept}
    assert not any(item in t for d, t in kept if d in left for item in items)
    share = lambda t: max(len(brute.shingle_set(i) & brute.shingle_set(t)) / len(brute.shingle_set(i)) for i in items)
    assert all(share(t) > 0.2 for t in gone)
    tokenizer = library_tokenizer("byte_bpe_50k.json")
    faults, _ = brute.packing_faults([(d, t) for d, t in kept if d in left], found, lambda t: tokenizer.encode(t, add_special_tokens=False).ids)
    assert faults == []


def test_stages_keep_columns(spark, tiny_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tiny_dir).dtypes == docs.dtypes


def test_one_python_worker_for_each_task(spark, tiny_dir, monkeypatch):
    """An executor's Python workers are as many as its cores: no stage runs two Python operators, and no rows are made by workers of another kind."""
    import re

    import corpus_pipeline
    from pyspark import SparkContext
    from stratiform.llm import decontamination, jaccard_join, packing, shared

    seen = []

    def watched(df, name, *more):
        stages = re.split(r"(?<!Broadcast)Exchange", df._jdf.queryExecution().executedPlan().toString())
        seen.append((name, max(len(re.findall(r"MapInArrow", x)) for x in stages)))
        return shared.stored(df, name, *more)

    for module in (corpus_pipeline, decontamination, jaccard_join, packing):
        monkeypatch.setattr(module, "stored", watched)
    monkeypatch.setattr(SparkContext, "parallelize", None)
    assert corpus_pipeline.run(spark, tiny_dir).count()
    assert {"scores", "token-sets", "pieces"} <= {name for name, _ in seen}
    assert [x for x in seen if x[1] > 1] == []


def test_entry_without_llm(tmp_path):
    code = "import sys; sys.path.insert(0, r'%s'); import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), 'unit_time_fit' in e.queries())"
    subprocess.run(["cp", "-r", str(ROOT / "stratiform"), str(ROOT / "__spark_entry__.py"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "stratiform/llm")], check=True)
    said = subprocess.run([sys.executable, "-c", code % tmp_path], capture_output=True, text=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})
    assert said.stdout.split() == ["0", "True"], said.stderr
