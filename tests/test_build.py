"""The dataset build keeps its promises: disjoint groups, no leakage, counters that add up."""

import pytest
from conftest import SMALL

from seqloom.catalog.splits import built
from seqloom.plans import dataset_build as B


@pytest.fixture(scope="module")
def result(spark):
    return built(spark, SMALL)


def test_no_cluster_on_both_sides(result):
    held = {("finetune_de", "test_de"), ("finetune_inp", "test_inp"), ("pretrain", "test_de"), ("pretrain", "test_inp")}
    shared = {(r["split_a"], r["split_b"]) for r in result["overlaps"].collect()}
    assert not shared & held


def test_sequences_are_disjoint_from_the_tests(result):
    rows = result["splits"].collect()
    test = {r["sequence"] for r in rows if r["split"].startswith("test")}
    assert test and not test & {r["sequence"] for r in rows if not r["split"].startswith("test")}


def test_counters(result):
    for r in result["filter_counts"].collect():
        assert r["before"] >= r["after_internal"] >= r["after_train_vs_test"] >= 0
    sizes = {}
    for r in result["splits"].collect():
        sizes[r["split"]] = sizes.get(r["split"], 0) + 1
    for r in result["filter_counts"].collect():
        assert sizes.get(r["split"], 0) == r["after_train_vs_test"]


def test_summary_covers_all_splits(result):
    s = {r["split"]: r["n"] for r in B.split_summary(result).collect()}
    assert set(s) == {r["split"] for r in result["splits"].select("split").distinct().collect()}
