"""Bad rows and labels stop every phase with a message that names them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.arrow import BadRow, matrix, tensor
from tidewatch.operators import labels
from tidewatch.operators.checks import guard_rows, row_report
from tidewatch.operators.windows import attach_expert_labels
from tidewatch.plans.initialize import initialize
from tidewatch.plans.online import replay_online
from tidewatch.plans.params import Params
from tidewatch.streaming.online import stream_online

ROWS, INIT = 900, 600


def series(spark, width, bad=None, at=None):
    """A noisy series in which row ``at`` is replaced by ``bad`` (x, is_anomaly)."""
    draw = np.random.default_rng(3)
    rows = [(i, draw.random(width).tolist(), i % 90 == 5) for i in range(ROWS)]
    if at is not None:
        rows[at] = (at, *bad)
    return spark.createDataFrame(rows, "idx long, x array<double>, is_anomaly boolean")


def settings(width):
    return Params(5, 4, 2, width, INIT, 1, 50, kind="profile")


def odd_rows(width):
    good = [0.5] * width
    yield (good + [0.5], False), f"does not have {width} features|do not have {width} features"
    yield (None, False), f"does not have {width} features|do not have {width} features"
    yield ([float("nan")] + good[1:], False), "null or NaN feature"
    yield ([None] + good[1:], False), "null or NaN feature"
    yield (good, None), "no label"


@pytest.mark.parametrize("width", [1, 3])
def test_bad_rows_stop_initialization_and_replay(spark, width):
    model = initialize(series(spark, width), settings(width))
    for bad, message in odd_rows(width):
        with pytest.raises(ValueError, match=message):
            initialize(series(spark, width, bad, 17), settings(width))
        with pytest.raises(Exception, match=rf"row {777 - INIT} .*({message})"):
            replay_online(series(spark, width, bad, 777), model, settings(width), adapt=False).windows.collect()


def test_bad_rows_stop_a_stream(spark, tmp_path):
    model = initialize(series(spark, 2), settings(2))
    series(spark, 2, ([float("nan"), 1.0], False), 777).filter(F.col("idx") >= INIT).write.parquet(str(tmp_path / "rows"))
    source = spark.readStream.schema("idx long, x array<double>, is_anomaly boolean").parquet(str(tmp_path / "rows"))
    writer = stream_online(source, model, settings(2), ["idx"], str(tmp_path / "run"), str(tmp_path / "out"), adapt=False)
    with pytest.raises(Exception, match="row 777 has a null or NaN feature"):
        writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()


def test_good_rows_pass_the_guard(spark):
    s = series(spark, 2)
    assert guard_rows(s, 2).exceptAll(s).isEmpty()
    assert row_report(series(spark, 2, ([1.0], None), 3), 2).first().asDict() == {"rows": ROWS, "wrong_width": 1, "bad_features": 0, "unlabelled": 1}


@pytest.mark.parametrize("rows", [[[[1.0, 2.0], [3.0]]], [[[1.0, 2.0]]], [[[1.0, 2.0], None]], [None], [[[1.0, None], [3.0, 4.0]]], [[[1.0, float("nan")], [3.0, 4.0]]]])
def test_tensors_of_bad_rows(rows):
    good = [[1.0, 2.0], [3.0, 4.0]]
    with pytest.raises(BadRow) as caught:
        tensor(pa.array([good, *rows], pa.list_(pa.list_(pa.float64()))), 2, 2)
    assert caught.value.row == 1
    assert tensor(pa.array([good], pa.list_(pa.list_(pa.float64()))), 2, 2).tolist() == [good]


def test_matrices_of_bad_rows():
    for rows in ([[1.0]], [None], [[1.0, None]]):
        with pytest.raises(BadRow):
            matrix(pa.array([[1.0, 2.0], *rows], pa.list_(pa.float64())), 2)


def test_a_missing_label_is_not_normal(spark):
    df = spark.createDataFrame([("normal.",), ("x",), (None,)], "label string")
    assert [r["is_anomaly"] for r in labels.canonical_label(df).collect()] == [False, True, True]


def test_several_verdicts_on_a_window_are_one(spark):
    windows = spark.createDataFrame([(w, False) for w in range(4)], "w long, is_anomaly boolean")
    verdicts = spark.createDataFrame([(1, True), (1, False), (1, True), (2, False), (2, False)], "w long, is_anomaly boolean")
    got = sorted((r["w"], r["is_anomaly"]) for r in attach_expert_labels(windows, verdicts).collect())
    assert got == [(0, False), (1, True), (2, False), (3, False)]
