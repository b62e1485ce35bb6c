"""The pipeline's stages on a small table, each against what brute force keeps of its own input."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from voxelith.llm import langid

from .test_pairs import classes, held
from .test_rows import check_shards, water


def test_stages(spark, sf, docs):
    columns = docs.columns
    after = {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, sf).cache()
        after[name] = rows
        if name != "shard":
            assert rows.columns == columns
        own = lambda d: [tuple(r) for r in d.select("doc_id", "text").orderBy("doc_id").collect()]
        if name == "language_id":
            gone = {r.doc_id for r in langid.identify(before).where("rejected").collect()}
            assert {i for i, _ in own(rows)} == {i for i, _ in own(before)} - gone and 0 < len(gone) < 0.06 * before.count()
        elif name == "near_dedup":
            x = own(before)
            assert own(rows) == [x[i] for i in sorted(set(classes(x)))]
        elif name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            gone = {d for d, _ in held(own(before), items)}
            assert gone and own(rows) == [r for r in own(before) if r[0] not in gone]
        elif name == "mix":
            size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
            was = {r.source: r.n for r in before.groupBy("source").agg(F.sum(size).alias("n")).collect()}
            now = {r.source: r.n for r in rows.groupBy("source").agg(F.sum(size).alias("n")).collect()}
            longest = before.agg(F.max(size)).first()[0]
            for s, t in water(was, 1.5 * sum(was.values())).items():
                assert abs(now.get(s, 0) - t) <= longest
            assert rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
        else:
            check_shards(before)
            assert rows.count() == before.count() and set(columns) <= set(rows.columns)
    assert corpus_pipeline.run(spark, sf).count() == after["shard"].count()


def test_stages_with_edges(spark, sf, edge, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge, sf).count() > 0
        assert stage(spark, empty, sf).count() == 0


def test_without_the_corpus_part(tmp_path):
    """The entry point works where the subpackage and the pipeline are gone."""
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(corpus_pipeline.__file__)
    shutil.copytree(f"{here}/voxelith", tmp_path / "voxelith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cosine_topk' in q and not [n for n in q if re.match('op[0-9]', n)] and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", f"import re; {code}"], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
