"""Digest trees, gates between studies, result files that are wrong, and weights refined step by step."""

import datetime
import hashlib
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from corploom.operators import audit, comparable, refinement
from corploom.sources import snapshots

rng = random.Random(9)
SCHEMA = "k long, name string, x double, s struct<a:int,b:array<string>>, t timestamp"


@pytest.fixture(scope="module")
def rows():
    at = datetime.datetime(2024, 5, 1)
    out = [(i * 3, rng.choice(["é", "", None, "a b"]), rng.choice([None, rng.random(), 0.1]), (i, ["u", None]) if i % 5 else None, at + datetime.timedelta(hours=i)) for i in range(900)]
    # a key that holds a third of the rows, rows that repeat, null and negative keys
    return [*out, *[(30, str(i), 0.5, None, None) for i in range(600)], *[out[7]] * 40, (None, "n", 1.0, None, None), (None, "m", 1.0, None, None), (-5, "neg", 1.0, None, None)]


def roots(spark, rows, **k):
    df = spark.createDataFrame(rows, SCHEMA)
    return snapshots.tree(df, "k", **k)


def test_equal_content_in_other_files_has_the_same_root(spark, rows, tmp_path):
    old = roots(spark, rows, width=64)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, SCHEMA).select("t", "s", "x", "k", "name").repartition(5)
    df.write.parquet(str(tmp_path / "copy"))
    again = spark.read.parquet(str(tmp_path / "copy"))
    new = snapshots.tree(again, "k", width=64)
    assert snapshots.root(new).first() == snapshots.root(old).first() and snapshots.changed(old, new).count() == 0
    assert snapshots.root(old).first()["n"] == len(rows)
    assert snapshots.pinned(again, "k", old, width=64).count() == len(rows)


def test_one_changed_cell_is_located(spark, rows):
    old = roots(spark, rows, width=64)

    def found(changed):
        return {(r["range"], r["change"], r["old_n"], r["new_n"]) for r in snapshots.changed(old, roots(spark, changed, width=64)).collect()}

    bent = [(*r[:2], 0.25, *r[3:]) if r[0] == 300 else r for r in rows]
    assert [x[:2] for x in found(bent)] == [(300 // 64, "changed")]
    assert found([r for r in rows if r[0] != -5]) == {(-1, "gone", 1, None)}
    assert found([*rows, (10**6, "far", None, None, None)]) == {(10**6 // 64, "added", None, 1)}
    assert {x[:2] for x in found([r for r in rows if r[1] != "m"])} == {(None, "changed")}
    copies = [r for r in rows if r == rows[7]]
    assert len(copies) > 1 and {x[:2] for x in found([r for i, r in enumerate(rows) if i != 7])} == {(rows[7][0] // 64, "changed")}
    assert {x[:2] for x in found([r for r in rows if r[:2] != (30, "17")])} == {(0, "changed")}
    with pytest.raises(ValueError, match="4 changed"):
        snapshots.pinned(spark.createDataFrame(bent, SCHEMA), "k", old, width=64)


def test_other_keys_and_no_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    old = snapshots.tree(df, "name")
    assert snapshots.changed(old, snapshots.tree(df.where("name is null or name <> '17'"), "name")).count() == 1
    none = snapshots.tree(df.where("false"), "k")
    assert tuple(snapshots.root(none).first()) == (0, hashlib.sha256(b"").hexdigest())
    assert snapshots.changed(none, none).count() == 0


def test_gates_between_studies(spark):
    frame = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    old = frame([("a", "1"), ("b", "2"), ("c", None), ("gone", "x"), (None, "n")], "name", "value")
    new = frame([("a", "1"), ("b", "3"), ("c", None), ("new", "y"), (None, "n")], "name", "value")
    differ = comparable.differing(old, new, ["name"], "value")
    assert {tuple(r) for r in differ.collect()} == {("b", "2", "3"), ("gone", "x", None), ("new", None, "y")}
    nothing, contrasts = frame([], "name", "old", "new"), spark.range(3)
    declared = frame([("b", "2", "3"), ("gone", "x", None), ("new", None, "y")], "name", "old", "new")
    assert comparable.gated(contrasts, comparable.bars(differ, declared, nothing)).count() == 3
    for settings, inputs, says in (
        (declared.where("name <> 'b'"), nothing, "setting b"),
        (declared.unionByName(frame([("z", "0", "1")], "name", "old", "new")), nothing, "declared_only z"),
        (declared.where("name <> 'b'").unionByName(frame([("b", "2", "4")], "name", "old", "new")), nothing, "other_change b"),
        (declared, frame([("train", "d1", "d2")], "name", "old", "new"), "input train"),
    ):
        with pytest.raises(ValueError, match=says):
            comparable.gated(contrasts, comparable.bars(differ, settings, inputs))


def test_files_that_are_wrong(spark, tmp_path):
    """Missing, unexpected, doubled, broken in four ways, stale and false: each told, and nothing of those that are right."""
    began = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)

    def put(arm, seed, text, old=False, name="r"):
        folder = tmp_path / f"arm={arm}" / f"seed={seed}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.json").write_text(text)
        at = began.timestamp() + (-10 if old else 10)
        os.utime(folder / f"{name}.json", (at, at))

    whole = lambda n=4, m=2.5: json.dumps({"n": n, "metric": m}, indent=1)
    put("a", 0, whole())
    put("a", 2, whole(), old=True)
    put("a", 3, '{"n": 4, "met')
    put("a", 4, '{"n": 4}')
    put("a", 5, '{"n": 4, "metric": "high"}')
    put("a", 6, whole(m=2.5 + 1e-12))
    put("b", 0, whole(m=2.6))
    put("b", 1, whole(n=5, m=9.0), old=True)
    put("b", 2, whole())
    put("b", 2, whole(), name="again")
    put("c", 0, whole())
    declared = [("a", s) for s in range(7)] + [("b", s) for s in range(3)]
    cells = spark.createDataFrame([(*x, 4, 2.5) for x in declared], "arm string, seed int, n long, metric double")
    found = audit.receipts(spark, str(tmp_path), "arm string, seed int", "n long, metric double")
    got = audit.violations(found, cells, cells, ["arm", "seed"], ["n", "metric"], F.lit(began)).collect()
    assert sorted((r["arm"], r["seed"], r["problem"], r["field"] or "") for r in got) == sorted([
        ("a", 1, "missing", ""), ("a", 2, "stale", ""), ("a", 3, "broken", ""), ("a", 4, "broken", ""), ("a", 5, "broken", ""),
        ("b", 0, "false", "metric"), ("b", 1, "stale", ""), ("b", 1, "false", "n"), ("b", 1, "false", "metric"), ("b", 2, "twice", ""), ("c", 0, "unexpected", ""),
    ])


def test_refinement_as_a_plain_loop(spark):
    """Draws, what the proxy learns and the losses taken anew, over five steps; groups without rows or weight are never drawn."""
    data = [(i, rng.choice("abc"), rng.random() * (1 + i % 3)) for i in range(200)]
    pool = spark.createDataFrame(data, "id long, g string, x double").repartition(3)
    start = {"a": 2.0, "b": 1.0, "c": 0.0, "none": 5.0}
    slots = {t: [(rng.random(), rng.random()) for _ in range(50)] for t in range(1, 6)}
    proxy = refinement.MeanProxy(pool, "g", F.col("x"), 0.3, 0.8)
    weights = spark.createDataFrame(list(start.items()), "g string, w double")
    last, path = refinement.refine(pool, weights, "g", "id", lambda t: spark.createDataFrame(slots[t], "u double, v double"), 0.0, proxy.learn, proxy.losses, 1.5, 5)
    got = {(r["step"], r["g"]): r["w"] for r in path.collect()}
    groups = {g: sorted((i, x) for i, h, x in data if h == g) for g in "abc"}
    w, theta = {g: start[g] / 3 for g in "abc"}, 0.0
    for t in range(1, 6):
        batch = []
        for u, v in slots[t]:
            upto = 0.0
            for g in "abc":
                if upto <= u < upto + w[g]:
                    batch.append(groups[g][int(v * len(groups[g]))][1])
                upto += w[g]
        theta += 0.3 * (sum(batch) / len(batch) - theta)
        loss = {g: max(0.0, sum((x - theta) ** 2 - (x - 0.8) ** 2 for _, x in groups[g]) / len(groups[g])) for g in "abc"}
        e = {g: w[g] * math.exp(1.5 * loss[g]) for g in "abc"}
        w = {g: e[g] / sum(e.values()) for g in "abc"}
        assert all(math.isclose(got[t, g], w[g], rel_tol=1e-9, abs_tol=1e-12) for g in "abc")
    assert {r["g"]: round(r["w"], 9) for r in last.collect()} == {g: round(x, 9) for g, x in w.items()}
    _, short = refinement.refine(pool, weights, "g", "id", lambda t: spark.createDataFrame(slots[t], "u double, v double"), 0.0, proxy.learn, proxy.losses, 1.5, 5, settled=0.9)
    assert short.agg(F.max("step")).first()[0] == 1


def test_refinement_goes_on_where_weights_rest(spark):
    """No group has a loss at the second step, so no weight moves; the third has losses again."""
    pool = spark.createDataFrame([(i, "ab"[i % 2], float(i % 2)) for i in range(8)], "id long, g string, x double")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, w double")
    slots = spark.createDataFrame([(0.1, 0.1)], "u double, v double")
    losses = lambda state: spark.createDataFrame([("a", 0.0 if state == 2 else 1.0), ("b", 0.0)], "g string, loss double")
    _, path = refinement.refine(pool, weights, "g", "id", lambda t: slots, 0, lambda state, batch: state + 1, losses, 1.0, 4)
    got = {(r["step"], r["g"]): r["w"] for r in path.collect()}
    assert {t for t, _ in got} == {0, 1, 2, 3, 4}
    assert got[1, "a"] == got[2, "a"] < got[3, "a"] < got[4, "a"]


def test_runs_that_are_complete(spark):
    """Each condition bars a run by itself, the first is told, and the newest of several files counts."""
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    fine = {"bound_to": None, "completed_cells": 5, "failed_cells": 0, "baseline_status": None, "recovery_count": None, "full_clean_matrix": None, "written": at(9), "broken": False}
    cases = {
        "ok": ({}, 5, 0, None, True), "own": ({"bound_to": "own", "baseline_status": "complete", "recovery_count": 0, "full_clean_matrix": True}, 5, 0, None, True),
        "recovered": ({"recovery_count": 1}, 5, 0, None, False), "unclean": ({"full_clean_matrix": False}, 5, 0, None, False),
        "exit": ({}, 5, 1, "exit", False), "killed": ({}, 5, None, "exit", False), "gone": (None, 5, 0, "missing", False), "broken": ({"broken": True}, 5, 0, "broken", False),
        "stale": ({"written": at(1)}, 5, 0, "stale", False), "other": ({"bound_to": "ok"}, 5, 0, "other_run", False), "null": ({"failed_cells": None}, 5, 0, "counts", False),
        "negative": ({"completed_cells": -1}, 5, 0, "counts", False), "short": ({"completed_cells": 4}, 5, 0, "incomplete", False), "more": ({"completed_cells": 6}, 5, 0, "incomplete", False),
        "unknown": ({}, None, 0, "incomplete", False), "failed": ({"failed_cells": 1}, 5, 0, "failed", False), "baseline": ({"baseline_status": "running"}, 5, 0, "baseline", False),
    }
    runs = spark.createDataFrame([(r, c[1], c[2], at(3)) for r, c in cases.items()], "run_id string, expected long, exit_code int, began timestamp")
    files = [(r, *(fine | c[0]).values()) for r, c in cases.items() if c[0] is not None] + [("ok", *(fine | {"completed_cells": 2, "written": at(5)}).values())]
    progress = spark.createDataFrame(files, "run_id string, bound_to string, completed_cells long, failed_cells long, baseline_status string, recovery_count long, full_clean_matrix boolean, written timestamp, broken boolean")
    got = {r["run_id"]: (r["problem"], r["verified"], r["clean"]) for r in audit.completion(runs, progress).collect()}
    assert got == {r: (c[3], c[3] is None, c[4]) for r, c in cases.items()}
