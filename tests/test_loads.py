"""Bulk loads that are repeated and resumed, loops over failing rows, and SyncTeX lookups against all boxes."""

import json
import random

from pyspark.sql import functions as F

from brindle.operators import synctex
from brindle.sources import bulk

SCHEMA = "url string, title string, year int"


def test_each_record_ends_in_one_table(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join(['{"url": "u1", "title": "A", "year": 2001}', '{"url": "u2", "title": "B"', "", '{"url": "u1", "title": "again"}', '{"url": "u3", "title": "C", "year": "no"}', "[1]", '{"title": "no key"}', '{"url": "u4"}', '{"url": " ", "title": "x"}']))
    (source / "b.jsonl").write_text('{"url": "u5", "title": "E", "more": 1}\n')
    dry = bulk.load(spark, str(source), target, SCHEMA, "url", ("title",), dry_run=True)
    assert bulk.loaded_so_far(spark, target, SCHEMA).count() == 0 and dry.where("status = 'new'").count() == 2
    first = bulk.load(spark, str(source), target, SCHEMA, "url", ("title",))
    found = sorted((r.status, r.reason or "", r.value[:14]) for r in first.collect())
    assert [x[0] for x in found].count("broken") == 6 and {x[1] for x in found} == {"", "malformed", "missing url", "missing title"}
    assert sorted(r.url for r in bulk.loaded_so_far(spark, target, SCHEMA).collect()) == ["u1", "u5"]
    (source / "c.jsonl").write_text(json.dumps({"url": "u9", "title": "I"}) + "\n" + json.dumps({"url": "u5", "title": "E"}))
    again = bulk.load(spark, str(source), target, SCHEMA, "url", ("title",))
    assert {r.status: r["count"] for r in again.groupBy("status").count().collect()} == {"new": 1, "loaded": 4, "broken": 6}
    # a batch that broke off is not in the ledger, and its records are loaded again
    batches = sorted((tmp_path / "out").iterdir(), key=lambda p: p.stat().st_mtime)
    (batches[-1] / "_SUCCESS").unlink()
    for extra in batches[-1].glob("*._SUCCESS*"):
        extra.unlink()
    assert sorted(r.url for r in bulk.loaded_so_far(spark, target, SCHEMA).collect()) == ["u1", "u5"]
    assert bulk.load(spark, str(source), target, SCHEMA, "url", ("title",)).where("status = 'new'").count() == 1
    assert bulk.load(spark, str(source), target, SCHEMA, "url", limit=1).count() <= 1


def test_a_failing_row_ends_no_loop(spark):
    rows = spark.createDataFrame([(1, "ok 3", None), (2, "bad", False), (3, "", False), (4, None, None), (5, "ok 5", True), (6, "nothing", False), (7, "odd", False)], "id int, text string, has_metadata boolean")

    def work(row):
        if row["text"] == "bad":
            raise KeyError("x" * 500)
        return None if row["text"] == "nothing" else {"n": "text"} if row["text"] == "odd" else {"n": int(row["text"].split()[1])}

    found = {r.id: (r.outcome, r.found and r.found.n) for r in bulk.backfill(rows, work, "n int").collect()}
    assert found == {1: ("stored", 3), 2: ("failed", None), 3: ("skipped", None), 4: ("skipped", None), 5: ("kept", None), 6: ("none", None), 7: ("failed", None)}
    forced = bulk.backfill(rows, work, "n int", force=True)
    assert {r.id: r.outcome for r in forced.collect()}[5] == "stored" and max(len(r.error) for r in forced.where("error is not null").collect()) < 200
    assert bulk.backfill(rows.where("id > 9"), work, "n int").collect() == []


def test_lookups_against_all_boxes(spark):
    rng = random.Random(3)
    boxes = [(rng.randrange(2), i, rng.choice(["a.tex", "b.tex"]), rng.randrange(9), rng.randrange(2), *[float(rng.randrange(0, 300)) for _ in range(2)], float(rng.choice([0, 20, 60, 500])), float(rng.choice([0, 20, 60, 500]))) for i in range(200)]
    boxes += [(0, 900, None, 1, 0, 0.0, 0.0, 900.0, 900.0), (0, 901, "neg.tex", 1, 0, 10.0, 10.0, -5.0, 5.0), (1, 902, "twin.tex", 1, 1, *boxes[0][5:])]
    records = spark.createDataFrame(boxes, "run int, seq int, file string, line int, page int, x double, y double, width double, height double")
    points = [(i, rng.randrange(3), rng.randrange(2), float(rng.randrange(-20, 500)), float(rng.randrange(-20, 500))) for i in range(150)]
    found = {r.point: (r.file, r.line) for r in synctex.reverse(records, spark.createDataFrame(points, "point int, run int, page int, x double, y double")).collect()}
    for p, run, page, x, y in points:
        around = [(b[7] * b[8], b[1], b[2], b[3]) for b in boxes if b[:1] == (run,) and b[4] == page and b[2] and b[7] >= 0 and b[8] >= 0 and b[5] <= x <= b[5] + b[7] and b[6] <= y <= b[6] + b[8]]
        assert found[p] == (min(around)[2:] if around else (None, None))
    asks = spark.createDataFrame([(run, f, line) for run in range(3) for f in ("a.tex", "c.tex") for line in range(9)], "run int, file string, line int")
    for r in synctex.forward(records, asks).collect():
        mine = sorted(b for b in boxes if (b[0], b[2], b[3]) == (r.run, r.file, r.line))
        assert (r.page, r.x, r.height) == ((mine[0][4], mine[0][5], mine[0][8]) if mine else (None, None, None))
    assert synctex.forward(records, asks.where(F.lit(False))).collect() == []
