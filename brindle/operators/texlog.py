"""Attribution of TeX errors: which file and line of the tree a failed run's log speaks of, or that it cannot be told.

Logs are rows of lines, so one log may be as long as a table: lines that could say
something are picked by their shape, every reading of one as "path:line: message" is
looked up among the files of its run, and what a log says as a whole is a sum over
those lines. Documents can print what they like into a log, so a place is named only
if nothing contradicts it; verdict tells what did.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.store import written

#: What TeX and its driver print, the engines, messages that only follow from an earlier error.
STATISTICS = "Here is how much of TeX's memory you used:"
FATAL = "==> Fatal error occurred"
NO_PAGES = "No pages of output."
SUMMARY = "Collected error summary"
ENGINES = ("pdflatex", "xelatex")
FALLOUT = ("Emergency stop.",)
#: Lines below an error that may quote its source, lines of an excerpt, lines of one without an error.
WINDOW, EXCERPT, TAIL = 10, 12, 40
#: What an excerpt says first where the log has no error.
NO_ERROR_LINE = "No TeX error line was found in the log. Its last lines were:\n\n"
NOTHING_TYPESET = "The document produced no pages, and TeX reported no error.\n\n"
#: Characters that a file's path has at most on any system that runs TeX.
LONGEST_PATH = 4096
_MARK = ":[0-9]+: "


def engine_failed(stdout: Column, engine: Column) -> Column:
    """Whether the driver's own summary, the last one in its standard output, says that the engine ended with an error; false for null.

    The summary is the indented lines behind its heading, and one of them must say
    so word for word; an unknown engine counts as the first of ENGINES.
    """
    lines = F.split(F.coalesce(stdout, F.lit("")), r"\r\n|\r|\n")
    from_end = F.array_position(F.transform(F.reverse(lines), lambda x: x.startswith(SUMMARY)), F.lit(True))
    # an array's last lines: as many as stand behind the heading
    behind = F.when(from_end > 1, F.slice(lines, (F.size(lines) - from_end + 2).cast("int"), (from_end - 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform(behind, lambda x: ~x.startswith(" ")), F.lit(True))
    entries = F.when(stop > 0, F.slice(behind, F.lit(1), (stop - 1).cast("int"))).otherwise(behind)
    rule = F.when(engine.isin(*ENGINES), engine).otherwise(ENGINES[0])
    begin = F.concat(F.lit("  "), rule, F.lit(": Command for '"), rule, F.lit("' gave return code "))
    return F.exists(entries, lambda x: x.startswith(begin) & F.substr(x, F.char_length(begin) + 1).rlike(r"^[1-9][0-9]*\z"))


def normal_path(path: Column) -> Column:
    """A path without empty and dot segments, each parent taken back; one that climbs out keeps its leading parents."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    rooted = path.startswith("/")

    def step(seen: Column, x: Column) -> Column:
        stays = (x != "..") | (F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit("..")) == "..")
        return F.when(stays, F.array_append(seen, x)).otherwise(F.slice(seen, F.lit(1), F.size(seen) - 1))

    found = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    # above the root there is nothing
    return F.when(rooted, F.concat(F.lit("/"), F.regexp_replace(found, r"^(?:\.\.(?:/|$))+", ""))).otherwise(found)


def readings(line: Column) -> Column:
    """Array of struct (path, number, message): every way to read a line as path:number: message, for paths may hold colons too."""
    head = F.left(line, F.lit(LONGEST_PATH + 24))
    marks = F.regexp_extract_all(head, F.lit(_MARK), F.lit(0))
    between = F.slice(F.split(head, _MARK, -1), F.lit(1), F.size(marks))
    sizes = F.zip_with(between, marks, lambda a, b: F.char_length(a) + F.char_length(b))
    ends = F.slice(F.aggregate(sizes, F.array(F.lit(0)), lambda seen, n: F.array_append(seen, F.element_at(seen, -1) + n)), F.lit(2), F.size(sizes))
    each = F.zip_with(ends, marks, lambda end, mark: F.struct(F.left(line, end - F.char_length(mark)).alias("path"), F.regexp_extract(mark, "[0-9]+", 0).try_cast("long").alias("number"), F.trim(F.substr(line, end + 1)).alias("message")))
    # a branch is worked out where it is taken only, and few lines have a mark
    return F.when(head.rlike(_MARK), F.filter(each, lambda x: x["path"] != "")).otherwise(F.array().cast("array<struct<path:string,number:bigint,message:string>>"))


def log_lines(logs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (log, at, line) of logs that are one text each; at counts from 0. A line break at the end begins no line, a null log has none."""
    body = F.when(F.right(F.col(text), F.lit(1)).isin("\r", "\n"), F.regexp_replace(F.col(text), r"(?:\r\n|\r|\n)\z", "")).otherwise(F.col(text))
    return logs.where(F.col(text) != "").select(F.col(key).alias("log"), F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("at", "line"))


def _judged(lines: DataFrame, staged: DataFrame, runs: DataFrame, present: DataFrame | None, roots: tuple[str, ...]) -> DataFrame:
    """One row for each line that could say something: its shape, whether it names a file that exists, and the one staged place that it names."""
    bang, context = F.col("line").startswith("!"), F.col("line").rlike(r"^(?:\s|<|l\.[0-9])")
    quoted = F.nullif(F.regexp_extract("line", r"^l\.([0-9]+)(?: |\z)", 1), F.lit(""))
    # whatever has none of these says nothing, and most lines have none
    likely = lines.where(bang | F.col("line").startswith(STATISTICS) | F.contains("line", F.lit(FATAL)) | (F.col("line") == NO_PAGES) | F.col("line").startswith("l.") | F.col("line").rlike(_MARK))
    shapes = likely.select("log", "at", bang.alias("bang"), context.alias("context"), F.col("line").startswith(STATISTICS).alias("statistics"), F.contains("line", F.lit(FATAL)).alias("fatal"), (F.col("line") == NO_PAGES).alias("no_pages"), quoted.alias("quoted"), readings(F.col("line")).alias("readings"))
    telling = shapes.where(F.col("bang") | F.col("statistics") | F.col("fatal") | F.col("no_pages") | F.col("quoted").isNotNull() | (F.size("readings") > 0))
    place = runs.select("log", F.coalesce("main_dir", F.lit("")).alias("main_dir"))
    each = telling.join(place, "log").select("log", "at", "bang", "context", "statistics", "fatal", "no_pages", "quoted", "main_dir", F.posexplode_outer("readings").alias("k", "r"))
    printed = F.col("r.path")
    path = normal_path(F.when(printed.startswith("/") | (F.col("main_dir") == ""), printed).otherwise(F.concat("main_dir", F.lit("/"), printed)))
    at_root = F.coalesce(F.greatest(F.lit(False), *[printed.startswith(root) for root in roots]), F.lit(False)) if roots else F.lit(False)
    named = each.withColumn("path", path).withColumn("at_root", at_root)
    known = staged.select("log", normal_path(F.col("path")).alias("path"), F.lit(True).alias("staged"), "n_lines")
    if present is not None:
        known = known.unionByName(present.select("log", normal_path(F.col("path")).alias("path"), F.lit(False).alias("staged"), F.lit(None).cast("long").alias("n_lines")))
    known = known.groupBy("log", "path").agg(F.max("staged").alias("staged"), F.max("n_lines").alias("n_lines"))
    met = named.join(known, ["log", "path"], "left")
    spot = F.when(F.col("staged"), F.struct("path", F.col("r.number").alias("number"), "n_lines"))
    grouped = met.groupBy("log", "at").agg(
        *[F.max(c).alias(c) for c in ("bang", "context", "statistics", "fatal", "no_pages", "quoted")],
        F.max(F.col("staged").isNotNull() | F.col("at_root")).alias("names"),
        F.min(spot).alias("low"),
        F.max(spot).alias("high"),
        F.max_by(F.col("r.message"), F.when(F.col("staged"), F.col("k"))).alias("message"),
    )
    # two different places in one line are none
    return grouped.select("*", F.when(F.col("low") == F.col("high"), F.struct("low.path", "low.number", "low.n_lines", "message")).alias("spot")).withColumn("places", F.col("low").isNotNull()).drop("low", "high", "message")


def attribute(lines: DataFrame, staged: DataFrame, runs: DataFrame, present: DataFrame | None = None, roots: tuple[str, ...] = ()) -> DataFrame:
    """Rows (log, excerpt, file, line, verdict), one for each row of runs.

    lines: log, at, line. staged: log, path, n_lines of the tree's files. runs: log,
    main_dir (paths are printed relative to it), errored (see engine_failed).
    present: log, path of files that exist without being staged; roots: places whose
    files all exist. file and line are set together, and only if verdict is "found":
    one line before the closing statistics reports an error, it names one staged
    place, TeX's last words agree, its source is quoted by number close below, and
    the file has that many lines. A log without lines is "no error".
    """
    facts = written(_judged(lines, staged, runs, present, roots), "texlog")
    only = lambda flag: F.when(F.col(flag), F.col("at"))
    sums = facts.groupBy("log").agg(F.max(only("statistics")).alias("end"), F.max(F.when(F.col("fatal"), F.struct("at", "spot"))).alias("last_words"), F.min(F.when(F.col("bang") | F.col("places"), F.col("at"))).alias("first"), F.max("no_pages").alias("no_pages"))
    reports = facts.join(sums.select("log", "end"), "log").where((F.col("at") < F.col("end")) & ~F.col("context") & (F.col("bang") | F.col("names")))
    counted = reports.groupBy("log").agg(F.count("*").alias("n"), F.min("at").alias("error"), F.min_by("spot", "at").alias("spot"))
    alone = counted.where("n = 1").select("log", "error", F.col("spot.number").alias("number"))
    near = (F.col("at") > F.col("error")) & (F.col("at") <= F.col("error") + WINDOW) & (F.col("quoted") == F.col("number").cast("string"))
    agrees = facts.where(F.col("quoted").isNotNull()).join(alone, "log").where(near).select("log", F.lit(True).alias("agrees")).distinct()
    sizes = lines.groupBy("log").agg(F.max("at").alias("last"))
    logs = runs.select("log", F.coalesce("errored", F.lit(False)).alias("errored"))
    for part in (sizes, sums, counted, agrees):
        logs = logs.join(part, "log", "left")
    n, spot, words = F.coalesce("n", F.lit(0)), F.col("spot"), F.col("last_words")
    same = F.coalesce((words["spot"]["path"] == spot["path"]) & (words["spot"]["number"] == spot["number"]), F.lit(False))
    verdict = (
        F.when(n > 1, "ambiguous")
        .when(n == 0, F.when(F.col("first").isNull(), "no error").otherwise("no report"))
        .when(~F.col("errored"), F.when(F.coalesce("no_pages", F.lit(False)), "no pages").otherwise("not errored"))
        .when(spot.isNull(), "no place")
        .when(spot["message"].isin(*FALLOUT), "fallout")
        .when(words.isNotNull() & ~same, "contradicted")
        .when(F.col("agrees").isNull(), "uncorroborated")
        .when(~F.coalesce(spot["number"].between(1, spot["n_lines"]), F.lit(False)), "beyond the file")
        .otherwise("found")
    )
    begun = F.when((n == 1) & (F.col("first").isNull() | (F.col("error") > F.col("first") + EXCERPT - 1)), F.col("error")).otherwise(F.col("first"))
    tail = F.struct(F.greatest(F.col("last") - TAIL + 1, F.lit(0)).alias("low"), F.col("last").alias("high"))
    shown = F.when(F.col("verdict") == "ambiguous", F.struct(F.greatest("error", F.col("end") - TAIL).alias("low"), (F.col("end") - 1).alias("high"))).when(F.col("verdict").isin("no error", "no pages"), tail).otherwise(F.struct(F.col("begun").alias("low"), (F.col("begun") + EXCERPT - 1).alias("high")))
    judged = written(logs.withColumn("verdict", verdict).withColumn("begun", begun).select("log", "verdict", shown.alias("shown"), F.when(F.col("verdict") == "found", spot).alias("spot")), "texlog-verdicts")
    cut = lines.join(judged.select("log", "shown"), "log").where(F.col("at").between(F.col("shown.low"), F.col("shown.high"))).groupBy("log").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "line")))["line"], "\n").alias("cut"))
    said = F.when(F.col("verdict") == "no error", NO_ERROR_LINE).when(F.col("verdict") == "no pages", NOTHING_TYPESET).otherwise("")
    return judged.join(cut, "log", "left").select("log", F.concat(said, F.coalesce("cut", F.lit(""))).alias("excerpt"), F.col("spot.path").alias("file"), F.col("spot.number").alias("line"), "verdict")
