"""Plans that must hold at scale: no nested loops, no single-task windows, pruned scans."""

import pytest
from conftest import SMALL

from seqloom.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


NO_LOOP = [
    "activity_filter", "attach_cluster", "exclude", "sample_with_parent", "score_cache", "merge_on", "nearest_join", "cross_pairs",
    "exact_motif_hits", "motif_profile", "shares_word", "similar_pairs", "identity_matrix", "group_holdout", "balance_index", "desirability",
    "histogram", "bin_column", "position_frequencies", "log_odds", "take_until", "ecdf", "zip_columns", "row_ids", "summarize_split", "auc",
]


@pytest.mark.parametrize("name", NO_LOOP)
def test_no_nested_loop(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_two_columns_and_pushes_the_filter(spark):
    text = plan(QUERIES["keep_if"](spark, SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text
    assert "GreaterThan(o_totalprice,250000.0)" in text


def test_scan_columns_of_a_text_query(spark):
    text = plan(QUERIES["peptide_mass"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_scalar_queries_stay_out_of_python(spark):
    # motif_profile is none of them: its motifs are found by an automaton in Arrow tasks.
    for name in ("sequence_profile", "isoelectric_point", "hydrophobic_moment", "tokenize", "order_agnostic_mask"):
        text = plan(QUERIES[name](spark, SMALL))
        assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


def test_one_row_statistics_are_scalar_subqueries(spark):
    text = plan(QUERIES["balance_index"](spark, SMALL))
    assert "Subquery" in text and "Join" not in text
