"""Every registered query against its SQL counterpart, and a look at every plan."""

import re

import pytest

from oracle_check import ROOT, compare, connect
from workload.catalog import ORACLES, QUERIES

SF = "0.001"
# Trained models: SQL has no counterpart, the unit tests check them.
NO_SQL = {
    "score_batch",
}
PYTHON_OPERATORS = {"cosine_topk", "cosine_topk_items", "keyword_mmr", "keyword_mmr_documents", "positive_pairs", "positive_pairs_floor"}
# Tags are looked up row by row in Python.
PYTHON_OPERATORS |= {"bio_tags", "bio_tags_floor", "align_subtokens", "align_subtokens_pieces", "token_accuracy", "train_tagger", "score_batch"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    said = compare(spark, con, SF, QUERIES[name], ORACLES[name])
    assert said.startswith("ok"), said


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, f"{ROOT}/sf{SF}").count() > 0


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == NO_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    plan = QUERIES[name](spark, f"{ROOT}/sf{SF}")._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan or (name, operator) == ("score_own_model", "ArrowEvalPython")
    if name not in PYTHON_OPERATORS:
        assert "InPandas" not in plan and "InArrow" not in plan
    # A text is read only by queries that look at it.
    if name in {"train_test_split", "min_rows_gate", "report_header", "label_to_id"}:
        schemas = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]
        assert schemas and not any("text:" in s for s in schemas)
