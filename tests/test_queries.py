import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracles import TABLES, rows_of

# The whole list runs with ``python check_oracles.py``; these keep the test run short.
CHECKED = [
    "clean_text", "merge_posts", "author_sentences", "split_sentences", "segment_request", "sample_caps", "top_words",
    "top_trigrams", "top_char_fourgrams", "sentence_type", "vader_scores", "top_emotions", "parse_tree_depth", "pos_ratios",
    "style_profile", "style_centroid", "drop_near_copies", "rewrite_selection", "greedy_refine_compat", "shuffle_batches",
    "pad_sequences", "request_status", "stream_registry_upsert",
]


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry_points.queries()[name](spark, sf)
    mine = [tuple(r) for r in df.collect()]
    cursor = duck.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert mine and rows_of(df.columns, mine) == rows_of(columns, theirs)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() == 20 and df.columns[0] == "author"


def test_names():
    names = set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= names and len(names) > 140
