"""A reader gets the tables of one whole run; a run that fails leaves the former set."""
import os

import numpy as np
import pytest

from feedspark.operators.tuning import Projection
from feedspark.plans import offline
from feedspark.sources import artifacts as AR
from feedspark.sources import fixtures as FX


def test_a_failed_run_leaves_the_old_set(spark, sf, tmp_path, monkeypatch):
    out = str(tmp_path / "art")
    # what the run computes is not the matter here
    monkeypatch.setattr(offline.CE, "compare_variants", lambda variants, labels, k: labels.sparkSession.createDataFrame([], "variant string, metric string, value double, note string"))
    monkeypatch.setattr(offline, "tune", lambda base: Projection(np.eye(64)))
    inputs = lambda: (FX.articles(spark, sf), FX.user_preferences(spark, sf), FX.interactions(spark, sf).limit(10))
    offline.run_offline(spark, *inputs(), out)
    first = AR.current(spark, out)
    before = AR.load_artifacts(spark, out)[0]["user_profiles"].count()

    def fails(*_, **__):
        raise RuntimeError("executors lost")

    with monkeypatch.context() as m:
        m.setattr(offline.P, "user_profiles", fails)
        with pytest.raises(RuntimeError, match="lost"):
            offline.run_offline(spark, *inputs(), out)
    arts, ok = AR.load_artifacts(spark, out)
    assert ok and AR.current(spark, out) == first and arts["user_profiles"].count() == before
    assert all(f.startswith("file:" + first) or first in f for f in arts["base_embeddings"].inputFiles())


def test_pointer_is_swapped_and_old_runs_go(spark, tmp_path):
    out = str(tmp_path / "art")
    assert AR.current(spark, out) == out
    folders = []
    for i in range(4):
        folder = AR.new_snapshot(out)
        AR.write_table(spark.range(i + 1), folder, "user_profiles")
        AR.publish_snapshot(spark, out, folder)
        folders.append(folder)
        assert AR.current(spark, out) == folder
    assert AR.load_artifacts(spark, out)[0]["user_profiles"].count() == 4
    assert AR.prune_snapshots(spark, out, keep=2) == 2
    assert os.path.isdir(folders[-1]) and len(os.listdir(os.path.join(out, "runs"))) == 2
    assert not [f for f in os.listdir(out) if f.startswith(".CURRENT-")]


def test_other_errors_are_not_taken_for_missing_tables(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "art")
    AR.write_table(spark.range(2), root, "user_profiles")
    os.makedirs(os.path.join(root, "interactions"))  # no table in it
    arts, ok = AR.load_artifacts(spark, root)
    assert not ok and arts["interactions"] is None and arts["user_profiles"].count() == 2

    def out_of_reach(*_):
        raise OSError("store out of reach")

    monkeypatch.setattr(AR, "exists", out_of_reach)
    with pytest.raises(OSError):
        AR.load_artifacts(spark, root)
