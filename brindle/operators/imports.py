"""Imports of archives into trees of files, in two steps: a plan that writes nothing, and a commit that is refused if anything has moved since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.config import CONFIG, EngineConfig
from brindle.functions import text as X
from brindle.operators.planning import plan_writes

#: Path of the entry that says how a tree is compiled; it is read, never written.
MANIFEST = ".project.json"


def import_plan(entries: DataFrame, targets: DataFrame, tree: DataFrame, revisions: DataFrame, manifest: str = MANIFEST) -> DataFrame:
    """Rows (archive, document, base_revision, seq, path, n_bytes, existing, suggestion): what each archive would write, and which name it would collide with.

    entries: archive, seq, path, n_bytes; no path twice as it is spelled. targets: archive, document to merge into,
    null for a new one. tree: document, path of what is there. revisions: document,
    revision. existing is the taken name as it is spelled, suggestion the first free
    one; both are null for a free path. Names of one archive collide with each
    other, too, in the order of seq. An archive without a target has no rows.
    """
    landing = entries.where(F.col("path") != manifest).join(targets, "archive").select("archive", "document", "seq", "path", "n_bytes")
    there = targets.where("document is not null").join(tree, "document").select("archive", F.lit(-1).cast("long").alias("seq"), "path", F.lit(True).alias("old"))
    both = there.unionByName(landing.select("archive", F.col("seq").cast("long").alias("seq"), "path", F.lit(False).alias("old")))
    named = plan_writes(both, "archive", "seq", "path", "old")
    taken = named.select("archive", F.lower("planned").alias("key"), F.col("planned").alias("existing"))
    # a row whose name had to change meets the one that has the name
    moved = named.where((F.col("seq") >= 0) & (F.col("planned") != F.col("path"))).withColumn("key", F.lower("path")).join(taken, ["archive", "key"]).select("archive", "seq", "existing", F.col("planned").alias("suggestion"))
    now = revisions.select("document", F.col("revision").alias("base_revision"))
    return landing.join(moved, ["archive", "seq"], "left").join(now, "document", "left").select("archive", "document", "base_revision", "seq", "path", "n_bytes", "existing", "suggestion")


def _worst(reasons: dict[str, Column]) -> Column:
    """The first of the reasons that holds for any row of a group; null if none does."""
    return F.min(F.coalesce(*[F.when(holds, F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"))) for i, (name, holds) in enumerate(reasons.items())]))["name"]


def import_commit(plan: DataFrame, commits: DataFrame, decisions: DataFrame, tree: DataFrame, revisions: DataFrame, manifest: str = MANIFEST, config: EngineConfig = CONFIG) -> tuple[DataFrame, DataFrame]:
    """Verdicts (archive, document, verdict, n_files, revision) for each row of commits, and the rows (archive, document, path, n_bytes) that land.

    commits: archive, document as the request names it, and seq, the order in which
    requests arrive. decisions: archive, path, new_path. tree and revisions: as they
    are now, tree with n_bytes. A request is refused whole, for the first of these
    that holds: it was never planned; it names another document than the plan; the
    document's revision has moved since, or an earlier request of this batch moves
    it; a decision on a path that the archive lacks; a new path that is none, or the
    manifest's; a name that is taken in the tree or twice in the archive, whatever
    its case; a file, a tree or a number of files beyond the bounds.
    """
    planned = plan.groupBy("archive").agg(F.first("document").alias("planned_for"), F.first("base_revision").alias("base_revision"))
    asked = commits.join(planned.withColumn("planned", F.lit(True)), "archive", "left").join(revisions, "document", "left")
    heads = asked.select("archive", "document", "seq", "base_revision", "revision", F.coalesce(F.when(F.col("planned").isNull(), "unknown"), F.when(~F.col("planned_for").eqNullSafe(F.col("document")), "other target"), F.when(~F.col("base_revision").eqNullSafe(F.col("revision")), "stale")).alias("head"))
    known = plan.select("archive", "path", F.lit(True).alias("known"))
    chosen = decisions.join(known, ["archive", "path"], "left").select("archive", "path", "known", X.path_verdict(F.col("new_path")).alias("v"))
    target = F.col("v.normalized")
    faults = chosen.groupBy("archive").agg(_worst({"not in the archive": F.col("known").isNull(), "bad path": target.isNull(), "reserved": target == manifest}).alias("fault"))
    moved = chosen.where(F.col("known") & target.isNotNull()).groupBy("archive", "path").agg(F.max(target).alias("target"))
    landing = plan.join(heads.where("head is null").select("archive"), "archive").join(moved, ["archive", "path"], "left").select("archive", "document", F.coalesce("target", "path").alias("path"), "n_bytes")
    there = landing.select("archive", "document").distinct().where("document is not null").join(tree, "document").select("archive", F.lower("path").alias("key"), "n_bytes", F.lit(0).alias("own"))
    all_names = landing.select("archive", F.lower("path").alias("key"), "n_bytes", F.lit(1).alias("own")).unionByName(there)
    names = all_names.groupBy("archive", "key").agg(F.count("*").alias("n"), F.sum("own").alias("own"), F.sum("n_bytes").alias("bytes"), F.max(F.when(F.col("own") == 1, F.col("n_bytes"))).alias("most"))
    sizes = names.groupBy("archive").agg(F.max((F.col("n") > 1) & (F.col("own") > 0)).alias("collides"), F.sum("own").alias("n_files"), F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), F.max("most").alias("most"))
    judged = heads.join(faults, "archive", "left").join(sizes, "archive", "left")
    own = F.coalesce("head", "fault", F.when(F.col("collides"), "collision"), F.when((F.col("most") > config.file_bytes_cap) | (F.col("bytes") > config.tree_bytes_cap) | (F.col("files") > config.tree_files_cap), "too large"))
    judged = judged.withColumn("own", own)
    # of the requests that could be written into one document the first is: it moves the revision
    turn = Window.partitionBy("document", F.when(F.col("document").isNull(), F.col("archive"))).orderBy(F.col("own").isNotNull(), "seq")
    first = (F.col("document").isNull()) | (F.row_number().over(turn) == 1)
    verdict = F.coalesce("own", F.when(first, "ok").otherwise("stale"))
    verdicts = judged.withColumn("verdict", verdict).select("archive", "document", "verdict", F.when(F.col("verdict") == "ok", F.col("n_files")).otherwise(0).cast("long").alias("n_files"), F.when(F.col("verdict") == "ok", F.coalesce("revision", F.lit(0)) + 1).otherwise(F.col("revision")).alias("revision"))
    return verdicts, landing.join(verdicts.where("verdict = 'ok'").select("archive"), "archive", "left_semi")
