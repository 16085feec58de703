"""Written tables and checkpoints go when they are discarded; what is made once is made again when its files change."""

import os

from brindle.store import discard, kept, once, written


def files(frame):
    path = frame.written_to.removeprefix("file:")
    return os.path.exists(path)


def test_discarded_tables_leave_no_files(spark):
    rows = spark.range(100)
    for make in (lambda: written(rows, "gone"), lambda: kept(rows)):
        frame = make()
        assert frame.count() == 100 and files(frame)
        discard(frame)
        assert not files(frame)
    discard(rows)  # nothing was written of it


def test_folders_hold_their_values_alone(spark):
    frame = written(spark.range(10).selectExpr("id", "int(id % 3) AS part"), "parts", ["part"])
    assert sorted(r.id for r in frame.where("part = 1").collect()) == [1, 4, 7] and frame.columns == ["id", "part"]


def test_once_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    made = []
    get = lambda: once(spark, "sizes", [path], lambda: made.append(1) or spark.read.parquet(path).count())
    assert (get(), get(), len(made)) == (3, 3, 1)
    spark.range(5).write.mode("append").parquet(path)
    assert (get(), len(made)) == (8, 2)
