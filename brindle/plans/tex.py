"""Queries over TeX runs: which file and line a failed run's log blames. The runs are made from the texts of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.bindings import table, words
from brindle.operators import texlog
from brindle.registry import register
from brindle.store import written


def tex_runs(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, log, stdout, engine, main_dir and files (path, n_lines) of one run for each document.

    The log holds the whole text as what the document printed. Its first words name the
    files, its number of words gives the line and decides what else the log says:
    a report that is forged, quoted by another number, beyond the file or without a
    place, TeX's last words or none, a driver that saw an error or not.
    """
    docs = table(spark, sf, "documents").select("doc_id", "text", words(F.col("text")).alias("w")).where(F.size("w") > 2).withColumn("n", F.size("w"))
    name = lambda i: F.concat(F.regexp_replace(F.get("w", F.lit(i)), "[/.]", ""), F.lit(i), F.lit(".tex"))
    docs = docs.withColumns({"chapter": F.concat(F.lit("chapters/"), name(0)), "main": name(1), "line": (F.col("n") % 50 + 1).cast("string"), "engine": F.when(F.col("n") % 3 == 0, "xelatex").otherwise("pdflatex"), "in_dir": F.char_length("text") % 2 == 0})
    report = F.concat(F.lit("./"), "chapter", F.lit(":"), "line", F.lit(": Undefined control sequence."))
    kind = F.col("n") % 8
    quote = F.concat(F.lit("l."), F.when(kind == 1, (F.col("line") + 1).cast("int").cast("string")).otherwise(F.col("line")), F.lit(" \\"), F.get("w", F.lit(2)))
    last = F.when(F.col("engine") == "pdflatex", F.concat(F.lit("./"), F.when(kind == 2, F.col("main")).otherwise(F.col("chapter")), F.lit(":"), "line", F.lit(":  ==> Fatal error occurred, no output PDF file produced!")))
    parts = F.array_compact(
        F.array(
            F.lit("This is TeX"),
            F.col("text"),
            F.when(kind == 3, F.concat(F.lit("./"), "main", F.lit(":1: Undefined control sequence."))),
            F.when(kind == 4, F.lit("! Missing $ inserted.")).when(kind == 5, F.concat(report, F.lit(" ./"), "main", F.lit(":7: quoted"))).when(kind != 6, report),
            F.lit("<recently read> \\x"),
            quote,
            F.lit("               "),
            F.when(kind == 7, F.lit("No pages of output.")),
            F.lit("Here is how much of TeX's memory you used:"),
            F.lit(" 427 strings out of 467159"),
            last,
        )
    )
    failed = F.when(F.col("n") % 5 == 0, F.concat(F.lit("  "), "engine", F.lit(": failed to create output file"))).otherwise(F.concat(F.lit("  "), "engine", F.lit(": Command for '"), "engine", F.lit("' gave return code 1")))
    stdout = F.array_join(F.array(F.lit("Latexmk: running"), F.lit("Collected error summary (may duplicate other messages):"), failed, F.lit("      Refer to the log"), F.lit("Latexmk: done")), "\n")
    main_dir = F.when(F.col("in_dir"), "paper").otherwise("")
    place = lambda path: F.when(F.col("in_dir"), F.concat(F.lit("paper/"), path)).otherwise(path)
    lines = F.col("line").cast("long")
    files = F.array(F.struct(place(F.col("chapter")).alias("path"), F.when(F.col("n") % 11 == 0, lines - 1).otherwise(lines + 3).alias("n_lines")), F.struct(place(F.col("main")).alias("path"), F.lit(9).cast("long").alias("n_lines")))
    return docs.select("doc_id", F.array_join(parts, "\n").alias("log"), stdout.alias("stdout"), "engine", main_dir.alias("main_dir"), files.alias("files"))


@register("tex_log_attribution")
def tex_log_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """File, line and excerpt of each run's error, or why it cannot be told. Held against a plain loop over each log in the tests."""
    # read again and again below: written, so that texts are split into words once
    runs = written(tex_runs(spark, sf), "tex-runs")
    lines = texlog.log_lines(runs, "doc_id", "log")
    staged = runs.select(F.col("doc_id").alias("log"), F.inline("files"))
    told = runs.select(F.col("doc_id").alias("log"), "main_dir", texlog.engine_failed(F.col("stdout"), F.col("engine")).alias("errored"))
    return texlog.attribute(lines, staged, told).withColumnRenamed("log", "doc_id")
