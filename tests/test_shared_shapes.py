"""Features of one geometry: evaluated once, answered each."""

import json

import pytest

from zonalis.operators.batch import envelopes
from zonalis.operators.masks import distinct_shapes
from zonalis.plans import engine as planner
from zonalis.plans.engine import Engine
from zonalis.queries import SHAPES
from zonalis.sources.pixels import events_catalog, px_events
from zonalis.sources.sinks import to_records

NAMES = {"t1": "triangle", "t2": "triangle", "d": "donut", "t3": "triangle", "o1": "outside", "o2": "outside"}


@pytest.fixture
def features(spark):
    rows = [(f, json.dumps(SHAPES[n])) for f, n in NAMES.items()] + [("bad1", "{}"), ("bad2", "{}"), ("none1", None), ("none2", None)]
    return spark.createDataFrame(rows, "fid string, geometry string")


@pytest.fixture
def masked(monkeypatch):
    """How many features each call of the mask was given."""
    calls, whole = [], planner.mask_features
    monkeypatch.setattr(planner, "mask_features", lambda pixels, features, grid: (calls.append(features.count()), whole(pixels, features, grid))[1])
    return calls


@pytest.mark.parametrize("text", ["SELECT COUNT(*) FROM event__type", "SELECT loss__year, COUNT(*) AS n FROM data GROUP BY loss__year ORDER BY n DESC, loss__year LIMIT 3", "SELECT loss__year, latitude, longitude FROM data ORDER BY loss__year DESC, latitude, longitude LIMIT 4"])
def test_features_share_a_geometry(spark, sf_dir, features, masked, text):
    engine = Engine(spark, events_catalog(), px_events(spark, sf_dir))
    got = [tuple(r) for r in engine.sql_many(text, features).collect()]
    want = [(f, *r.values()) for f, n in sorted(NAMES.items()) for r in to_records(engine.sql(text, SHAPES[n]))]
    assert sorted(got) == sorted(want)
    if "ORDER" in text:
        assert got == want
    assert masked == [5]  # of ten features: three shapes, one unusable text and null


def test_envelopes_share_a_geometry(spark, sf_dir, features, masked):
    engine = Engine(spark, events_catalog(), px_events(spark, sf_dir))
    text = "SELECT loss__year, COUNT(*) AS n FROM data GROUP BY loss__year ORDER BY n DESC, loss__year LIMIT 3"
    got = {r.fid: r for r in envelopes(engine, text, features).collect()}
    assert len(got) == 10 and masked == [5]
    for f, n in NAMES.items():
        assert got[f].status == "success" and json.loads(got[f].data) == to_records(engine.sql(text, SHAPES[n]))
    assert all(got[f].status == "failed" and got[f].message and got[f].data is None for f in ("bad1", "bad2", "none1", "none2"))


def test_shapes_are_dealt_out(spark):
    """Scanlines are made where their shapes are: a few small texts must not all come to one task."""
    box = lambda i: json.dumps({"type": "Polygon", "coordinates": [[[10, 4], [10.5 + i / 1000, 4], [10.5, 4.5], [10, 4.5]]]})
    features = spark.createDataFrame([(str(i), box(i % 40)) for i in range(80)], "fid string, geometry string")
    keyed, shapes = distinct_shapes(features)
    parts = [len(p) for p in shapes.rdd.glom().collect()]
    assert keyed.count() == 80 and sum(parts) == 40 and len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(parts) < 20
