"""Changes to keyed tables as new tables: upserts, cascades, running caps, renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.scan import running
from brindle.store import hinted, written

#: Anchors of needles that are broadcast at most.
ANCHORS_AT_ONCE = 1_000_000


def replace_groups(base: DataFrame, new: DataFrame, touched: DataFrame, group: str) -> DataFrame:
    """base without the rows of touched groups, and new instead; a touched group without new rows is emptied."""
    return base.join(touched.select(group).distinct(), group, "left_anti").select(base.columns).unionByName(new.select(base.columns))


def upsert(base: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: of new the last by order, else that of base. Both sides meet in one aggregation."""
    columns = [c for c in base.columns if c not in keys]
    tagged = base.select(*keys, F.struct(F.lit(0).alias("side"), F.lit(None).cast(new.schema[order].dataType).alias("o"), *columns).alias("row")).unionByName(new.select(*keys, F.struct(F.lit(1).alias("side"), F.col(order).alias("o"), *columns).alias("row")))
    return tagged.groupBy(*keys).agg(F.max("row").alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in columns])


def insert_missing(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti").select(base.columns))


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """base with those fields of patch that are not null."""
    fields = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    return base.join(p, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


def first_over_cap(rows: DataFrame, group: str, order: list[str], size: str, total: int, files: int) -> DataFrame:
    """rows with running_bytes, running_files and whether each still fits its group's caps."""
    out = running(rows, group, order, {"running_bytes": F.col(size), "running_files": F.lit(1)})
    return out.withColumn("fits", (F.col("running_bytes") <= total) & (F.col("running_files") <= files))


def renamed(path: Column, source: str, target: str) -> Column:
    """A directory's new name in the paths below it; others as they are. A directory cannot move into itself."""
    if target == source or target.startswith(f"{source}/"):
        raise ValueError("a directory cannot move into itself")
    return F.when(path.startswith(f"{source}/"), F.concat(F.lit(target), F.substr(path, F.lit(len(source) + 1)))).otherwise(path)


def ancestors(path: Column) -> Column:
    """All directories above a path, the highest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def word_runs(rows: DataFrame, words: str, width: Column, most: int, at: str = "at") -> DataFrame:
    """The other columns of rows, once for each run of width words (1 to most): with its place and its hash, gram.

    Words are hashed once; the array is passed on by reference and read at each place.
    """
    hashed = rows.withColumns({"__h": F.transform(words, lambda w: F.xxhash64(w)), "__width": width})
    last = F.size("__h") - F.col("__width")
    placed = hashed.select(*[c for c in rows.columns if c != words], "__h", "__width", F.explode(F.when((last >= 0) & (F.col("__width") > 0), F.sequence(F.lit(0), last))).alias(at))
    each = [F.when(F.col("__width") > i, F.get(F.col("__h"), F.col(at) + i)) for i in range(most)]
    return placed.select(*[c for c in rows.columns if c != words], at, F.xxhash64("__width", *each).alias("gram"))


def anchored_contains(docs: DataFrame, needles: DataFrame, doc: str, text: str, needle: str, needle_text: str, run: int = 4) -> DataFrame:
    """Pairs (doc, needle) where the text contains the needle, case and all, without comparing all with all.

    A run of whole words from within the needle must stand in the text, so runs
    are joined by hash and only those pairs are looked at. Needles of one or two
    words have no whole word within; see _short_contains. Documents and needles
    have keys of their own.
    """
    inner = lambda t: F.filter(F.split(t, r"\s+"), lambda x: x != "")
    n = needles.select(F.col(needle).alias("needle"), F.col(needle_text).alias("wanted")).where(F.char_length("wanted") > 0)
    counted = n.withColumn("parts", inner(F.col("wanted")))
    # of the words within, as many as a run has, or all there are
    long = counted.where(F.size("parts") >= 3).select("needle", F.slice("parts", F.lit(2), F.least(F.lit(run), F.size("parts") - 2)).alias("parts"))
    d = docs.select(F.col(doc).alias("doc"), F.col(text).alias("body"))
    anchors = word_runs(long, "parts", F.size("parts"), run).select("needle", "gram")
    widths = sorted(r[0] for r in long.select(F.size("parts").alias("width")).distinct().collect())
    parts = d.select("doc", inner(F.col("body")).alias("parts"), F.explode(F.array(*map(F.lit, widths or [run]))).alias("width"))
    grams = word_runs(parts, "parts", F.col("width"), run)
    hits = grams.select("doc", "gram").join(hinted(anchors, ANCHORS_AT_ONCE), "gram").select("doc", "needle").distinct()
    by_anchor = hits.join(n, "needle").join(d, "doc").where(F.contains("body", "wanted")).select("doc", "needle")
    short = counted.where(F.size("parts") < 3).select("needle", "wanted")
    return by_anchor.unionByName(_short_contains(d, short))


def _short_contains(d: DataFrame, short: DataFrame) -> DataFrame:
    """Pairs (doc, needle) of needles of at most two words, any number of them; d: doc, body, short: needle, wanted.

    A needle's longest word (a blank one's blanks) lies within a word (within
    blanks) of the text, so it is looked up among the pieces of the corpus's
    different words, each of which is cut up once; only texts that have such a word
    are looked at, and only for needles that are more than it.
    """
    tokens = lambda c: F.regexp_extract_all(c, F.lit(r"\s+|\S+"), F.lit(0))
    longest = lambda xs: F.array_sort(F.transform(xs, lambda x: F.struct((-F.char_length(x)).alias("n"), x.alias("x"))))[0]["x"]
    solid = F.filter(tokens(F.col("wanted")), lambda x: ~x.rlike(r"^\s"))
    named = written(short.select("needle", "wanted", F.coalesce(F.when(F.size(solid) > 0, longest(solid)), F.col("wanted")).alias("anchor")), "needles")
    lengths = sorted(r[0] for r in named.select(F.char_length("anchor").alias("n")).distinct().collect())
    if not lengths:
        return d.select("doc", F.lit(None).cast(short.schema["needle"].dataType).alias("needle")).where(F.lit(False))
    words = d.select("doc", F.explode(F.array_distinct(tokens(F.col("body")))).alias("word"))
    vocabulary = words.select("word").distinct()
    cut = vocabulary.select("word", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where(F.char_length("word") >= F.col("n"))
    pieces = cut.select("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - F.col("n") + 1), lambda i: F.substr("word", i, F.col("n"))))).alias("anchor"))
    met = written(pieces.join(hinted(named.select("anchor").distinct(), ANCHORS_AT_ONCE), "anchor"), "pieces")
    found = words.join(hinted(met, ANCHORS_AT_ONCE), "word").select("doc", "anchor").distinct().join(hinted(named, ANCHORS_AT_ONCE), "anchor")
    whole = found.where(F.col("anchor") == F.col("wanted")).select("doc", "needle")
    more = found.where(F.col("anchor") != F.col("wanted")).join(d, "doc").where(F.contains("body", "wanted")).select("doc", "needle")
    return whole.unionByName(more)
