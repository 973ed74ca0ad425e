"""The review log as a stream against its state in one batch."""

import random

from sheafline.operators import review
from sheafline.streaming import review_log

COLUMNS = ["bundle_id", "status", "route", "reasons", "opened_at", "closed_at", "reviewer", "conclusion", "edits", "note"]


def _log(dice):
    """Events of 40 bundles with times of their own: opened up to three times, closed up to three times, some only closed."""
    times, rows = list(range(1000)), []
    dice.shuffle(times)
    for b in range(40):
        for _ in range(dice.randint(0, 3)):
            rows.append((f"b{b}", "open", dice.choice(["REVIEW", "REQUEST_MORE"]), dice.choice([["R1"], [], None, ["R2", "R3"]]), None, None, None, None, float(times.pop())))
        for _ in range(dice.randint(0, 3)):
            rows.append((f"b{b}", "close", None, None, dice.choice("xyz"), dice.choice(review.CONCLUSIONS), dice.choice(["{}", None]), "n", float(times.pop())))
    return rows + [("late", "open", "REVIEW", [], None, None, None, None, None), (None, "open", "REVIEW", [], None, None, None, None, 5000.0)]


def _run(spark, folder, **kw):
    events = spark.readStream.schema(review.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder / "log"))
    q = review_log.keep(events, str(folder / "items"), str(folder / "c"), availableNow=True, **kw)
    assert q.awaitTermination(240) and q.exception() is None


def _items(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=str)


def test_replayed_and_reordered_batches_give_the_state(spark, tmp_path):
    rows = _log(random.Random(3))
    want = _items(review.state(spark.createDataFrame(rows, review.EVENTS)))
    assert len(want) > 25 and {w[1] for w in want} == {"open", "closed"}
    dealt = rows + random.Random(4).sample(rows, 50)  # writers that repeat each other's events
    random.Random(5).shuffle(dealt)
    for part in (dealt[:70], dealt[70:]):
        spark.createDataFrame(part, review.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    _run(spark, tmp_path)
    assert _items(review_log.current(spark, str(tmp_path / "items"))) == want
    # a writer sends the whole log again: the stream goes on from its state and nothing changes
    n = spark.read.parquet(str(tmp_path / "items")).count()
    spark.createDataFrame(rows[::-1], review.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    _run(spark, tmp_path)
    assert spark.read.parquet(str(tmp_path / "items")).count() == n
    assert _items(review_log.current(spark, str(tmp_path / "items"))) == want


def test_items_left_open_are_told_of(spark, tmp_path):
    opened = [(b, "open", "REVIEW", [], None, None, None, None, 1.0) for b in ("a", "b")]
    closed = [("a", "close", None, None, "x", "valid", "{}", "", 2.0)]
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a stream with timers has no last batch
    try:
        for part in (opened, closed, [("c", "open", "REVIEW", [], None, None, None, None, 3.0)]):
            spark.createDataFrame(part, review.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
            _run(spark, tmp_path, overdue_ms=1)
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", before)
    got = {r["bundle_id"]: (r["status"], r["overdue"]) for r in review_log.current(spark, str(tmp_path / "items")).collect()}
    assert got["a"] == ("closed", False) and got["b"] == ("open", True) and got["c"][0] == "open"
