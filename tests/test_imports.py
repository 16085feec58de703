"""Imports in two steps: plans against a growing set of names, and every reason to refuse a commit."""

from dataclasses import replace

from brindle.config import CONFIG
from brindle.operators import imports as I


def frames(spark, entries, targets, tree, revisions):
    return (
        spark.createDataFrame(entries, "archive int, seq bigint, path string, n_bytes bigint"),
        spark.createDataFrame(targets, "archive int, document int"),
        spark.createDataFrame(tree, "document int, path string, n_bytes bigint"),
        spark.createDataFrame(revisions, "document int, revision bigint"),
    )


def test_plan(spark):
    entries = [(1, 0, "Main.tex", 5), (1, 1, "a/plot.png", 5), (1, 2, "a/PLOT.png", 5), (1, 3, "a/plot (1).png", 5), (1, 4, I.MANIFEST, 5), (2, 0, "x", 1), (2, 1, "X", 1), (3, 0, "lost", 1)]
    rows = I.import_plan(*frames(spark, entries, [(1, 7), (2, None)], [(7, "main.tex", 1), (7, "a/plot.png", 1), (8, "x", 1)], [(7, 4)]))
    found = {(r.archive, r.path): (r.document, r.base_revision, r.existing, r.suggestion) for r in rows.collect()}
    assert found == {
        (1, "Main.tex"): (7, 4, "main.tex", "Main (1).tex"),
        (1, "a/plot.png"): (7, 4, "a/plot.png", "a/plot (1).png"),
        (1, "a/PLOT.png"): (7, 4, "a/plot.png", "a/PLOT (2).png"),
        (1, "a/plot (1).png"): (7, 4, "a/plot (1).png", "a/plot (1) (1).png"),
        (2, "x"): (None, None, None, None),
        (2, "X"): (None, None, "x", "X (1)"),
    }


def test_commit(spark):
    names = range(1, 13)
    entries = [(a, 0, "new.tex", 10) for a in names] + [(a, 1, I.MANIFEST, 1) for a in names] + [(8, 2, "main.tex", 3), (9, 2, "main.tex", 3), (10, 2, "NEW.tex", 3), (11, 2, "big.bin", 99)]
    targets = [(a, None if a in (5, 10) else a) for a in names if a != 12] + [(12, 1)]
    tree = [(a, "main.tex", 20) for a in names]
    old = [(a, 3) for a in names]
    now = [(a, 4 if a == 2 else 3) for a in names]
    e, t, files, before = frames(spark, entries, targets, tree, old)
    plan = I.import_plan(e, t, files, before)
    commits = spark.createDataFrame([(1, 1, 5), (2, 2, 0), (3, 4, 0), (4, 4, 0), (5, None, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0), (10, None, 0), (11, 11, 0), (12, 1, 9), (99, 1, 0)], "archive int, document int, seq bigint")
    decisions = spark.createDataFrame([(4, "gone.tex", "a"), (6, "new.tex", "a/../b"), (7, "new.tex", "./" + I.MANIFEST), (9, "main.tex", "./other.tex"), (5, "new.tex", "a/b.tex")], "archive int, path string, new_path string")
    revisions = spark.createDataFrame(now, "document int, revision bigint")
    config = replace(CONFIG, file_bytes_cap=50)
    verdicts, landing = I.import_commit(plan, commits, decisions, files, revisions, config=config)
    found = {r.archive: (r.verdict, r.n_files, r.revision) for r in verdicts.collect()}
    assert found == {
        1: ("ok", 1, 4), 2: ("stale", 0, 4), 3: ("other target", 0, 3), 4: ("not in the archive", 0, 3), 5: ("ok", 1, 1), 6: ("bad path", 0, 3), 7: ("reserved", 0, 3),
        8: ("collision", 0, 3), 9: ("ok", 2, 4), 10: ("collision", 0, None), 11: ("too large", 0, 3), 12: ("stale", 0, 3), 99: ("unknown", 0, 3),
    }
    assert {(r.archive, r.path) for r in landing.collect()} == {(1, "new.tex"), (5, "a/b.tex"), (9, "new.tex"), (9, "other.tex")}
    for bound in ({"tree_bytes_cap": 29}, {"tree_files_cap": 1}):
        tight, _ = I.import_commit(plan, commits.where("archive = 1"), decisions, files, revisions, config=replace(config, **bound))
        assert tight.first().verdict == "too large"
