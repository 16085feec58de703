"""Readers: Crossref messages, golden sets, JSON from noisy model output, archives, SyncTeX records, sinks."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brindle.config import CONFIG
from brindle.functions import text as X

DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF = f"title array<string>, author array<struct<given:string,family:string,name:string>>, published {DATE}, `published-print` {DATE}, `published-online` {DATE}, issued {DATE}, `container-title` array<string>"
GOLDEN = "version int, cases array<struct<id:string,kind:string,question:string,paper_title_contains:string,expect_substrings:array<string>>>"
KINDS = ("content", "figure", "metadata", "off_topic")


def crossref(message: Column) -> Column:
    """Struct (title, authors, year, venue) of a message; each field on its own, absent ones null."""
    m = F.from_json(message, CROSSREF)
    first = lambda c: F.nullif(F.trim(X.unescaped(F.get(c, F.lit(0)))), F.lit(""))
    person = lambda a: F.coalesce(F.nullif(F.concat_ws(" ", F.nullif(F.trim(a["given"]), F.lit("")), F.nullif(F.trim(a["family"]), F.lit(""))), F.lit("")), F.nullif(F.trim(a["name"]), F.lit("")))
    year = F.coalesce(*[F.get(F.get(m[k]["date-parts"], F.lit(0)), F.lit(0)) for k in ("published", "published-print", "published-online", "issued")])
    authors = F.slice(F.filter(F.transform(F.coalesce(m["author"], F.array().cast("array<struct<given:string,family:string,name:string>>")), person), lambda x: x.isNotNull()), 1, 50)
    return F.struct(first(m["title"]).alias("title"), F.transform(authors, lambda a: F.left(a, F.lit(200))).alias("authors"), F.when(year.between(1500, 2100), year).alias("year"), F.left(first(m["container-title"]), F.lit(300)).alias("venue"))


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a set; any defect is fatal: unknown kinds, empty questions, repeated ids, needles that a kind must (not) have."""
    return checked_cases(spark.read.schema(GOLDEN).json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*"))


def checked_cases(cases: DataFrame) -> DataFrame:
    """Cases with trimmed needles; ValueError, naming one, if any is malformed or its id is repeated."""
    needles = F.transform(F.coalesce("expect_substrings", F.array().cast("array<string>")), lambda x: F.trim(x))
    cases = cases.withColumn("expect_substrings", needles)
    off = F.col("kind") == "off_topic"
    sound = F.col("kind").isin(*KINDS) & (F.trim("question") != "") & (F.trim("id") != "") & F.when(off, (F.size("expect_substrings") == 0) & F.col("paper_title_contains").isNull()).otherwise((F.size("expect_substrings") > 0) & F.forall("expect_substrings", lambda x: x != ""))
    bad = cases.where(~F.coalesce(sound, F.lit(False))).select(F.coalesce("id", F.lit("?")).alias("id")).union(cases.groupBy("id").count().where("count > 1").select("id")).limit(1).collect()
    if bad:
        raise ValueError(f"case {bad[0]['id']} is malformed or repeated")
    return cases


def first_object(text: str | None) -> str | None:
    """The first whole JSON object in a model's output, without what it thought before; null if there is none.

    What is nested too deeply to be read is no object.
    """
    body, kept, at = text or "", [], 0
    # thoughts are cut out in one walk; one that is closed without having been opened takes all before it
    for close in re.finditer("</think>", body):
        begun = body.find("<think>", at, close.start())
        if begun < 0:
            kept.clear()
        else:
            kept.append(body[at:begun])
        at = close.end()
    body = "".join(kept) + body[at:]
    reader, at = json.JSONDecoder(), body.find("{")
    while at >= 0:
        try:
            return body[at : reader.raw_decode(body, at)[1]]
        except RecursionError:
            return None
        except ValueError:
            at = body.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def objects(texts: pd.Series) -> pd.Series:
    return texts.map(first_object)


def structured(first: Column, second: Column, schema: str) -> Column:
    """Struct (value, attempt) of two answers to one request, the second one to a stricter wording: the first object that has all fields of schema in their kinds; null if neither has.

    A field that is null, absent or of another kind fails an answer.
    """
    fields = T._parse_datatype_string(schema).fieldNames()

    def read(answer: Column) -> Column:
        found = F.from_json(objects(answer), schema, {"mode": "PERMISSIVE"})
        whole = F.lit(True)
        for name in fields:
            whole = whole & found[name].isNotNull()
        return F.when(whole, found)

    one, two = read(first), read(second)
    return F.when(one.isNotNull(), F.struct(one.alias("value"), F.lit(1).alias("attempt"))).when(two.isNotNull(), F.struct(two.alias("value"), F.lit(2).alias("attempt")))


class BadArchive(ValueError):
    pass


def archive_entries(data: bytes, most_files: int = CONFIG.tree_files_cap, most_bytes: int = CONFIG.tree_bytes_cap) -> list[tuple[str, bytes]]:
    """(path, bytes) of every file, without the folder that all share; anything wrong refuses the whole archive."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, NotImplementedError, EOFError, OSError, ValueError) as error:
        raise BadArchive("no archive") from error
    infos = [i for i in archive.infolist() if not i.is_dir() and "__MACOSX" not in i.filename and not i.filename.endswith(".DS_Store")]
    if len(infos) > most_files:
        raise BadArchive("too many files")
    out, left = [], most_bytes
    for info in infos:
        if info.flag_bits & 1 or info.external_attr >> 28 not in (0, 8):
            raise BadArchive("encrypted or special file")
        parts = [p for p in info.filename.split("/") if p != "."]
        if "\\" in info.filename or info.filename.startswith("/") or not all(parts) or ".." in parts or any(ord(c) < 32 for c in info.filename):
            raise BadArchive("bad path")
        try:
            with archive.open(info) as file:
                body = file.read(left + 1)
        # damaged data or checksum, a compression or a version that is not known, a head that lies
        except (zlib.error, zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError, ValueError) as error:
            raise BadArchive("damaged or unknown data") from error
        left -= len(body)
        if left < 0:
            raise BadArchive("too large")
        out.append(("/".join(parts), body))
    heads = {p.split("/")[0] for p, _ in out}
    if len(heads) == 1 and all("/" in p for p, _ in out):
        out = [(p.split("/", 1)[1], b) for p, b in out]
    if len({p.lower() for p, _ in out}) < len(out):
        raise BadArchive("names that differ by case alone")
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows (archive, path, data, is_binary, error) of all archives below a path; a refused archive is one row with its error."""
    files = spark.read.format("binaryFile").load(path)
    return unpacked(files.select(F.col("path").alias("archive"), "content"), "archive", "content")


def unpacked(archives: DataFrame, key: str, content: str) -> DataFrame:
    """Rows (key, path, data, is_binary, error) of archives held in a binary column; a null one is refused."""
    kinds = T.StructType([archives.schema[key], *T._parse_datatype_string("path string, data binary, is_binary boolean, error string").fields])
    columns = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [(name, p, b, is_binary(b), None) for p, b in archive_entries(data.as_py() or b"")]
                except BadArchive as error:
                    rows = [(name, None, None, None, str(error))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), columns, strict=True)], names=columns.names)

    return archives.select(key, content).mapInArrow(run, kinds)


def zipped(files: list[dict]) -> bytes:
    """An archive of files (path, data) with a fixed date, so equal files give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in files:
            archive.writestr(zipfile.ZipInfo(file["path"]), file["data"] or b"", zipfile.ZIP_DEFLATED)
    return out.getvalue()


def packed(trees: DataFrame, key: str, files: str, most_files: int = CONFIG.tree_files_cap, most_bytes: int = CONFIG.tree_bytes_cap) -> DataFrame:
    """Rows (key, archive) of trees with an array of files (path, data). ValueError for a tree beyond the bounds, as it could not be read again."""
    kinds = T.StructType([trees.schema[key], T.StructField("archive", T.BinaryType())])
    columns = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = batch.column(1)[i].as_py() or []
                if len(tree) > most_files or sum(len(f["data"] or b"") for f in tree) > most_bytes:
                    raise ValueError("a tree is too large for an archive")
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()], columns.field(0).type), pa.array([zipped(tree)], pa.binary())], names=columns.names)

    return trees.select(key, files).mapInArrow(run, kinds)


#: The engines that a manifest may name.
ENGINES = ("pdflatex", "xelatex")


def manifest(said: Column, texts: Column) -> Column:
    """Struct (main, engine) of a manifest: main is one of the tree's .tex texts, engine a known one; whatever is not is null.

    Strings alone count: a number or a list says nothing, and neither does what is no JSON object.
    """
    whole = F.try_parse_json(said)
    string = lambda name: F.when(F.schema_of_variant(F.try_variant_get(whole, f"$.{name}", "variant")) == "STRING", F.try_variant_get(whole, f"$.{name}", "string"))
    main, engine = string("main_path"), string("engine")
    return F.struct(F.when(F.array_contains(texts, main) & main.endswith(".tex"), main).alias("main"), F.when(engine.isin(*ENGINES), engine).alias("engine"))


def tree_path(recorded: Column, root: Column) -> Column:
    """A recorded input as a path below the root of its tree; null for any other place, and for one that climbs out of the tree."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    tail = F.substr(recorded, F.char_length(prefix) + 1)
    segments = F.filter(F.split(tail, "/"), lambda x: ~x.isin("", "."))
    none = F.array().cast("array<string>")
    # a parent takes back the folder before it; without one it stays and shows that the path climbs out
    climb = lambda seen: F.when(F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit("..")) != "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.array_append(seen, F.lit("..")))
    found = F.aggregate(segments, none, lambda seen, x: F.when(x == "..", climb(seen)).otherwise(F.array_append(seen, x)))
    inside = F.startswith(recorded, prefix) & (tail != "") & ~tail.startswith("/") & (F.coalesce(F.get(found, F.lit(0)), F.lit("")) != "..")
    return F.when(inside & (root != ""), F.when(F.size(found) == 0, ".").otherwise(F.array_join(found, "/")))


def is_binary(data: bytes) -> bool:
    try:
        return b"\0" in data or data.decode("utf-8") is None
    except UnicodeDecodeError:
        return True


def synctex_records(texts: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Rows (key, record, fields map) of Field:value lines; Output begins a record, and the first value of a field counts."""
    each = texts.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).where(F.contains("line", F.lit(":")))
    pair = each.select(key, "at", F.substring_index("line", ":", 1).alias("k"), F.expr("substr(line, instr(line, ':') + 1)").alias("v"))
    record = F.sum((F.col("k") == "Output").cast("int")).over(Window.partitionBy(key).orderBy("at"))
    once = pair.withColumn("record", record).where("record > 0").groupBy(key, "record", "k").agg(F.min_by("v", "at").alias("v"))
    return once.groupBy(key, "record").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("fields"))


def first_error(log: Column) -> Column:
    """Message of the first line of a TeX log that has one behind a ! or behind a place, path:line: ; null if none does."""
    blank = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def said(line: Column) -> Column:
        # a path has a character at least, and does not begin with a blank
        rest = F.substr(line, F.lit(2))
        at = F.regexp_instr(rest, F.lit(":[0-9]+:"))
        behind = blank(F.regexp_replace(F.substr(rest, at + 1), "^[0-9]+:", ""))
        placed = F.when((at > 0) & ~line.rlike(r"^\s"), F.nullif(behind, F.lit("")))
        return F.coalesce(placed, F.when(line.startswith("!"), F.nullif(blank(rest), F.lit(""))))

    return F.get(F.filter(F.transform(F.split(log, "\n"), said), lambda x: x.isNotNull()), F.lit(0))


#: Names of a main file at the top of a tree, blocks whose text is no source, packages that need XeTeX.
MAIN_NAMES = ("main.tex", "paper.tex", "ms.tex")
QUOTING = "verbatim|lstlisting|minted"
XETEX_PACKAGES = ("fontspec", "unicode-math", "polyglossia")


def live(source: Column) -> Column:
    """TeX without its comments and without the lines of blocks that only quote; a block that is never closed quotes the rest."""
    bare = F.regexp_replace(source, r"(?m)(?<!\\)((?:\\\\)*)%.*$", "$1")
    return F.regexp_replace(bare, rf"(?ms)^[^\n]*?\\begin\{{({QUOTING})\}}.*?(?:\\end\{{\1\}}[^\n]*$|\z)", "")


def engine(source: Column) -> Column:
    """xelatex for a source that loads a package which needs it, else pdflatex; null for null."""
    commands = F.split(live(source), r"\\(?:usepackage|RequirePackage)(?![A-Za-z])")
    # behind the command: options in brackets, if there are any, then the names in braces
    argument = lambda x: F.ltrim(F.when(F.ltrim(x).startswith("["), F.substr(x, F.instr(x, "]") + 1)).otherwise(x), F.lit(" \t\r\n"))
    inside = F.transform(F.filter(F.transform(F.slice(commands, 2, 1_000_000), argument), lambda x: x.startswith("{") & x.contains("}")), lambda x: F.substring_index(F.substr(x, F.lit(2)), "}", 1))
    names = F.transform(F.split(F.array_join(inside, ","), ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(source.isNotNull(), F.when(F.arrays_overlap(names, F.array(*map(F.lit, XETEX_PACKAGES))), "xelatex").otherwise("pdflatex"))


def main_files(tree: DataFrame, group: str = "document", path: str = "path", text: str = "text") -> DataFrame:
    """Rows (group, main, verdict): which .tex file with \\documentclass is compiled.

    The only one; else the only one with a usual name at the top; else, without
    any such name, the one nearest to the top. What is left is ambiguous.
    """
    found = tree.where(F.col(path).endswith(".tex") & F.coalesce(live(F.col(text)).rlike(r"\\documentclass"), F.lit(False)))
    usual = F.col(path).isin(*MAIN_NAMES)
    # usual names come before all depths, so one minimum serves both rules
    level = F.when(usual, -1).otherwise(F.size(F.split(path, "/")))
    best = found.groupBy(group, level.alias("level")).agg(F.count("*").alias("n"), F.min(path).alias("main")).groupBy(group).agg(F.min(F.struct("level", "n", "main")).alias("b"))
    rows = tree.select(group).distinct().join(best, group, "left")
    return rows.select(group, F.when(F.col("b.n") == 1, F.col("b.main")).alias("main"), F.when(F.col("b").isNull(), "none").when(F.col("b.n") > 1, "ambiguous").otherwise("ok").alias("verdict"))


def write_report(rows: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)
