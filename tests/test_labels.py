"""Annotations to gold boxes: mapping, clipping, order, and what is refused. Configurations and look-ups."""

import json

import pytest

from gleaner.operators import labels, selection
from gleaner.operators.contracts import ContractError
from gleaner.sources import tables


def samples(spark, tmp_path, *boxes, name="index.json"):
    found = [{"label": label, "bounding_box": box, **more} for label, box, more in boxes]
    index = {"samples": [{"filepath": "data/a.jpg", "metadata": {"width": 100, "height": 50}, "detections": {"detections": found}}, {"filepath": "b.jpg", "metadata": {"width": 9, "height": 9}}]}
    (tmp_path / name).write_text(json.dumps(index))
    return tables.annotations(spark, str(tmp_path / name))


def test_converted(spark, tmp_path):
    rows = samples(
        spark, tmp_path, ("car", [0.1, 0.2, 0.5, 0.5], {"occluded": True}), ("lane", [0.0, 0.0, -1.0, 0.0], {}), ("rider", [-0.5, 0.5, 1.0, 2.0], {"truncated": True}),
    )
    got = [tuple(r) for r in labels.gold(rows).orderBy("j").collect()]
    assert got == [("a", 3, 1, pytest.approx(10.0), pytest.approx(10.0), pytest.approx(60.0), pytest.approx(35.0), True, False), ("a", 1, 2, 0.0, 25.0, 50.0, 50.0, False, True)]


@pytest.mark.parametrize(
    "box,error",
    [([0.1, 0.1, 0.0, 0.1], "invalid box"), ([0.1, 0.1, 0.1, -0.1], "invalid box"), ([1.0, 0.1, 0.1, 0.1], "outside"), ([-0.3, 0.1, 0.3, 0.1], "outside"), ([0.1, None, 0.1, 0.1], "invalid box"), ([0.1], "invalid box")],
)
def test_refused(spark, tmp_path, box, error):
    rows = samples(spark, tmp_path, ("car", [0.1, 0.2, 0.5, 0.5], {}), ("bus", box, {}))
    assert [r.error is None for r in labels.converted(rows).orderBy("j").collect()] == [True, False]
    with pytest.raises(ContractError, match=error):
        labels.gold(rows)


def test_config(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"seeds": [1, 2], "gate": {"drop": 0.01}, "more": "x"}))
    assert tables.config(spark, str(path), "seeds array<int>, gate struct<drop:double>") == {"seeds": [1, 2], "gate": {"drop": 0.01}}
    for text, message in (('{"seeds": [1]}', "lacks gate"), ('{"seeds": "x", "gate": {}}', "seeds"), ("[", "no JSON")):
        path.write_text(text)
        with pytest.raises(ValueError, match=message):
            tables.config(spark, str(path), "seeds array<int>, gate struct<drop:double>")


def test_rows_of_chosen_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    ids = lambda *k: spark.createDataFrame([(i,) for i in k], "k int")
    assert sorted(r.v for r in selection.rows_of(rows, ids(1, 3, 3), "k").collect()) == ["a", "c"]
    with pytest.raises(ContractError, match="unknown: 9"):
        selection.rows_of(rows, ids(1, 9), "k")
    with pytest.raises(ContractError, match="unique k: 1"):
        selection.rows_of(rows.union(rows), ids(1), "k")
