import os
from pathlib import Path

import pytest

from __spark_entry__ import oracle_sql, queries
from clipmill.llm.queries import ORACLES, QUERIES
from compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).parents[2]

given = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


@given
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    rows, problems = differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name])
    assert not problems, "\n".join(problems)


@given
@pytest.mark.parametrize(
    "name, table, columns",
    [
        ("op4_mixing", "documents", "doc_id size source_size target taken"),
        ("op5_toxicity", "documents", "doc_id held_out score predicted"),
        ("op6_sharding", "documents", "doc_id size text_crc32 law shard slot grown_shard"),
        ("op8_quality_classifier", "documents", "doc_id held_out score predicted"),
        ("op9_url_filter", "pages", "page_id host path rule verdict"),
        ("op10_html_extraction", "pages", "page_id url text n_chars"),
        ("op11_token_files", "documents", "doc_id start n_tokens ids_crc32"),
    ],
)
def test_every_row_has_a_result(spark, name, table, columns):
    got = QUERIES[name](spark, SF_DIR)
    assert set(columns.split()) <= set(got.columns)
    assert got.count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


def test_every_operator_is_registered():
    names = queries().keys()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(oracle_sql()) <= set(names)


def test_nothing_else_imports_the_subpackage():
    for path in [*ROOT.glob("clipmill/**/*.py"), *ROOT.glob("workload/*.py")]:
        if "llm" not in path.parts:
            assert "clipmill.llm" not in path.read_text(), path
