"""The registered models are fitted with the whole settings of their operators."""

from __future__ import annotations

import os

import pytest

from aerolith.operators import cluster, forecast
from aerolith.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


class Seen(Exception):  # noqa: N818
    """Ends a query at the step that a test looks at."""


@pytest.mark.parametrize("name", ["kmeans_city_months", "clustering_tournament"])
def test_every_k_is_tried(spark, monkeypatch, name):
    def seen(ready, algorithm, ks):
        raise Seen(tuple(ks))

    monkeypatch.setattr(cluster, "pick_k", seen)
    with pytest.raises(Seen) as e:
        QUERIES[name](spark, FOLDER)
    assert e.value.args[0] == (2, 3, 4, 5, 6)


def test_density_sweep_has_every_setting(spark):
    rows = [(r.eps, r.size) for r in QUERIES["density_sweep"](spark, FOLDER).where("kind = 'dbscan'").collect()]
    assert sorted(rows) == [(e, m) for e in (0.5, 1.0, 1.5, 2.0, 2.5, 3.0) for m in (2, 3, 4)]


def test_forest_has_100_trees_of_depth_10(spark, monkeypatch):
    def seen(self, df):
        raise Seen(self.getNumTrees(), self.getMaxDepth())

    monkeypatch.setattr(forecast.RandomForestRegressor, "fit", seen)
    with pytest.raises(Seen) as e:
        QUERIES["rf_forecast"](spark, FOLDER)
    assert e.value.args == (100, 10)


def test_online_model_makes_30_epochs(spark, monkeypatch):
    def seen(self, chunk):
        raise Seen(self.epochs)

    monkeypatch.setattr(forecast.OnlineLinear, "_step", seen)
    with pytest.raises(Seen) as e:
        QUERIES["online_forecast"](spark, FOLDER)
    assert e.value.args == (30,)
