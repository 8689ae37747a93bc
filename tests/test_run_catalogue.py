"""The catalogue of runs: rows as path parsing gives them, and folders that a filter forbids are not listed."""

import itertools

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from quillon.operators import runs
from quillon.sources import files, run_catalogue


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("runs")
    for stamp, size, seed, ft, config, name in itertools.product(("2025", "x/y"), ("0.1", "0.3"), (1, 2, 30), ("all", "semantic"), ("c1", "c2"), ("GCN_ce_model.pt", "RGCN_focal_model.pt", "notes.txt")):
        folder = top / stamp / size / f"seed{seed}" / ft / "all" / "org_small_v2" / config
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("x")
    for odd in ("other/seed5/a/b/c/d/GCN_ce_model.pt", "0.2/seed7/short_model.pt", "GCN_ce_model.pt", "2025/0.1/seed99999999999/a/b/c/d/GCN_x_model.pt", "2025/0.1/seed1/all/all/org_small_v2/c1/deep/GIN_model.pt"):
        (top / odd).parent.mkdir(parents=True, exist_ok=True)
        (top / odd).write_text("x")
    return f"file://{top}"


def test_rows_are_those_of_parsed_paths(spark, root):
    got = {r.path: r for r in run_catalogue.saved_runs(spark, root).collect()}
    paths = files.find_models(spark, root).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    want = {r.path: r for r in runs.parsed_runs(paths).collect()}
    assert len(got) == 97 and set(got) == set(want)
    for path, r in got.items():
        assert r.asDict() == want[path].asDict(), path


def listed(root, *filters):
    reader = run_catalogue.RunReader(root)
    assert list(reader.pushFilters(list(filters))) == list(filters)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    return rows, [x.removeprefix(root) for x in reader.listed]


def test_a_lookup_by_seed_lists_no_other_seed(root):
    every, all_folders = listed(root)
    rows, folders = listed(root, EqualTo(("seed",), 2))
    assert [r for r in every if r[3] == 2] == rows and not any("seed1" in x or "seed30" in x for x in folders)
    assert len(folders) < len(all_folders) / 2
    rows, folders = listed(root, In(("seed",), (1, 30)), EqualTo(("test_size",), 0.3), EqualTo(("feature_type",), "all"), GreaterThan(("seed",), 0))
    assert len(rows) == 2 * 2 * 2 * 2 and not any("/semantic" in x or "seed2" in x or "0.1/seed" in x for x in folders)
    rows, folders = listed(root, EqualTo(("seed",), 2), EqualTo(("seed",), 1))
    assert rows == [] and not any("seed1" in x or "seed2" in x for x in folders)


def test_filters_reach_the_source(spark, root):
    asked = runs.lookup(run_catalogue.saved_runs(spark, root), ["GCN"], ["gcn_c"], seed=30, test_size=0.1, feature_config=["c2"])
    got = asked.collect()
    assert len(got) == 2 * 2 and {(r.seed, r.test_size, r.feature_config, r.model) for r in got} == {(30, 0.1, "c2", "GCN")}
    assert asked.rdd.getNumPartitions() == 2  # a seed's folder each
    assert run_catalogue.saved_runs(spark, root).rdd.getNumPartitions() > 10
    assert run_catalogue.saved_runs(spark, root).where("seed = 1234").count() == 0


def test_below_a_seed_and_nowhere(spark, root):
    assert run_catalogue.saved_runs(spark, f"{root}/2025/0.1/seed2").count() == 8
    with pytest.raises(Exception, match="(?i)not|exist"):
        run_catalogue.saved_runs(spark, f"{root}/none").count()
