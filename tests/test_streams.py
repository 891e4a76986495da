"""Streams that are stopped, run again and told things late."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corploom.plans import feeds
from corploom.sources import io
from corploom.streaming import events, masses

START = datetime.datetime(2024, 1, 1)
SCHEMA = "run string, step int, ts timestamp, note string"


def arrive(spark, folder, name, rows):
    spark.createDataFrame([(k, s, START + datetime.timedelta(hours=h) if h is not None else None, note) for k, s, h, note in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")


def advance(spark, places, **more):
    come = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(places[0])
    found = events.furthest(come, "run", F.col("step"), late="0 seconds", **more)
    events.ended(events.updates(found, places[1], places[2]))
    return {r["run"]: r for r in events.current(spark, places[1], found.schema, ["run"]).collect()}


def test_furthest_over_restarts(spark, places):
    """A stale record, a null one and a restart change nothing; ties go by time; what is furthest is one record, not two maxima."""
    arrive(spark, places[0], "a", [("x", 5, 10, "first"), ("x", 9, 1, "second"), ("y", 1, 2, None), (None, 4, 1, "no"), ("y", None, 1, "no"), ("y", 3, None, "no")])
    keep = {"keep": "30 days"}
    got = advance(spark, places, **keep)
    assert set(got) == {"x", "y"} and (got["x"]["step"], got["x"]["note"], got["x"]["ts"].hour, got["x"]["n_seen"]) == (9, "second", 1, 2)
    arrive(spark, places[0], "b", [("x", 7, 30, "stale, though later"), ("y", 1, 30, "tie, later")])
    got = advance(spark, places, **keep)
    assert (got["x"]["note"], got["y"]["note"], got["y"]["n_seen"]) == ("second", "tie, later", 2)
    assert advance(spark, places, **keep) == got
    arrive(spark, places[0], "c", [("x", 10, 40, "new")])
    assert advance(spark, places, **keep)["x"]["n_seen"] == 4


def test_furthest_goes_as_the_watermark_passes(spark, places):
    arrive(spark, places[0], "a", [("x", 5, 0, "old")])
    assert not advance(spark, places, keep="1 hour")["x"]["ended"]
    arrive(spark, places[0], "b", [("y", 1, 100, "moves the watermark")])
    advance(spark, places, keep="1 hour")
    arrive(spark, places[0], "c", [("y", 2, 101, "again")])
    got = advance(spark, places, keep="1 hour")
    assert got["x"]["ended"] and not got["y"]["ended"]
    arrive(spark, places[0], "d", [("x", 2, 102, "anew")])
    assert (advance(spark, places, keep="1 hour")["x"]["note"], got["x"]["note"]) == ("anew", "old")


def test_masses_replayed_and_compacted(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("one two three four five six".split()) for _ in range(20))
    d = str(tmp_path / "tables")
    spark.createDataFrame([(i, text(), "en", rng.choice(["s", "t", None])) for i in range(60)], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    for name in ("benchmark", "conversations"):
        spark.createDataFrame([(1, text()), (2, None)], "id long, text string").write.parquet(f"{d}/{name}.parquet")
    whole = lambda path, **k: sorted(map(str, masses.masses(spark, path, feeds.CELL_SCHEMA, ["domain", "bucket"], **k).selectExpr("domain", "bucket", "n", "round(score, 9)", "round(wrong, 9)", "words").collect()))
    every = whole(feeds.followed(spark, d, 3)[0])
    docs = io.table(spark, d, "documents")
    words = [feeds.known_words(spark, d, *x) for x in (("benchmark", "b"), ("conversations", "w"))]
    adder = lambda path: masses.adder(path, lambda b: feeds.scored_pool(b, *words), ["domain", "bucket"], feeds.CELL_SUMS)
    once, path = str(tmp_path / "once"), str(tmp_path / "parts")
    adder(once)(docs, 0)
    assert whole(once) == every and len(every) > 1
    add, batch = adder(path), docs.where("doc_id % 3 = 0")
    for i in range(3):
        add(docs.where(f"doc_id % 3 = {i}"), i)
    assert whole(path) == every
    add(batch, 0)
    assert whole(path) == every, "a batch that comes again replaces itself"
    before = whole(path, upto=1)
    masses.compact(spark, path, feeds.CELL_SCHEMA, ["domain", "bucket"], 1)
    assert whole(path) == every and masses.held(spark, path) == 1 and whole(path, upto=1) == before
    add(batch, 0)
    masses.compact(spark, path, feeds.CELL_SCHEMA, ["domain", "bucket"], 0)
    assert whole(path) == every and masses.held(spark, path) == 1
    add(docs.limit(5), 9)
    assert whole(path) != every
