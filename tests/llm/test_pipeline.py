import subprocess
import sys

import corpus_pipeline
import __spark_entry__ as entry_points
from penprint.llm.queries import QUERIES, SQL


def test_stages_keep_columns_and_never_add_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
        assert out.count() <= docs.count() and not out.join(docs, "doc_id", "left_anti").count()
        docs = out
    assert docs.count() and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_on_edge_rows_and_none(spark, sf, edge_docs, no_docs, tmp_path):
    for label, docs in (("edge", edge_docs), ("none", no_docs)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf).write.parquet(f"{tmp_path}/{label}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{label}{i}")
        assert (docs.count() > 0) == (label == "edge")


def test_names():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(SQL) < set(QUERIES) <= set(entry_points.queries()) and "pipeline" in entry_points.queries()


def test_the_rest_does_without_this_subpackage():
    code = (
        "import sys, importlib.util as u; f = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n in ('penprint.llm', 'corpus_pipeline') else f(n, *a)\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()) and len(e.oracle_sql()) > 100\n"
        "assert not any(m.startswith('penprint.llm') for m in sys.modules)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0])
