"""Native operators hold no Python in their plans, and texts aren't shuffled without need."""

import contextlib
import io

import pytest
from fluvial.llm import queries


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["op1_document_fingerprints", "op5_time_varying_curriculum", "op7_weighted_hash_tree"])
def test_columns_alone(spark, sf_dir, name):
    text = plan(queries.queries()[name](spark, sf_dir))
    assert not any(x in text for x in ("Python", "Pandas", "ArrowEval", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


@pytest.mark.parametrize("name", ["op4_counterfactual_toxicity", "op9_token_counts", "op10_progressive_jpeg"])
def test_nothing_is_shuffled(spark, sf_dir, name):
    assert "Exchange" not in plan(queries.queries()[name](spark, sf_dir))
