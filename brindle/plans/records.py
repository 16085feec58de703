"""Queries over records from outside: identifiers, Crossref messages, JSON in model output, archives, trees, mentions. Made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.bindings import table
from brindle.functions import mentions as M
from brindle.functions import text as X
from brindle.functions.folding import metadata_keyed
from brindle.operators import evaluation as ev
from brindle.registry import register
from brindle.sources import records as S


@register(
    "identifiers",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html, split_part(url, '/', 3) AS host, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS leaf FROM pages)
SELECT page_id, '10.' || (1000 + len(html)) || '/' || host || '(' || page_id || ')' AS doi,
CASE len(html) % 3 WHEN 0 THEN 'https://arxiv.org/abs/' || host || 'v2' WHEN 1 THEN 'http://arxiv.org/abs/' || host ELSE 'https://' || host || '/pdf/' || leaf || '.pdf' END AS page FROM p""",
)
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """The DOI in a line about a page, and the abstract page of a PDF's address; other addresses stay. Host and length of the page make both."""
    n, host = F.char_length(F.coalesce("html", F.lit(""))), F.split_part("url", F.lit("/"), F.lit(3))
    leaf = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    line = F.concat(F.lit("see https://doi.org/10."), 1000 + n, F.lit("/"), host, F.lit("("), "page_id", F.lit(')" and 10.5555/zz, or '), F.left("html", F.lit(50)))
    line = F.coalesce(line, F.concat(F.lit("see https://doi.org/10."), 1000 + n, F.lit("/"), host, F.lit("("), "page_id", F.lit(')" and 10.5555/zz')))
    address = F.when(n % 3 == 0, F.concat(F.lit("https://arxiv.org/pdf/"), host, F.lit("v2.pdf"))).when(n % 3 == 1, F.concat(F.lit("http://arxiv.org/pdf/"), host)).otherwise(F.concat(F.lit("https://"), host, F.lit("/pdf/"), leaf, F.lit(".pdf")))
    return table(spark, sf, "pages").select("page_id", X.doi(line).alias("doi"), X.abstract_page(address).alias("page"))


@register(
    "crossref_records",
    """SELECT doc_id, CASE WHEN doc_id % 6 <> 5 THEN concat('A & B ', doc_id) END AS title,
CASE doc_id % 4 WHEN 0 THEN concat('Ada Name', doc_id, '|A Group') WHEN 1 THEN concat('Name', doc_id) WHEN 2 THEN 'A Group' ELSE '' END AS authors,
CASE WHEN doc_id % 5 <> 4 AND 1400 + doc_id % 800 BETWEEN 1500 AND 2100 THEN CAST(1400 + doc_id % 800 AS INTEGER) END AS year, CASE WHEN lang IS NOT NULL THEN concat('Venue ', lang) END AS venue FROM documents""",
)
def crossref_records(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with entities, persons, groups, one of four kinds of date, years out of range, and missing fields."""
    n = F.col("doc_id")
    person = lambda given, family, name: F.struct(given.cast("string").alias("given"), family.cast("string").alias("family"), name.cast("string").alias("name"))
    none = F.lit(None)
    full, bare, group = person(F.lit(" Ada"), F.concat(F.lit("Name"), n), none), person(none, F.concat(F.lit("Name"), n), none), person(none, none, F.lit(" A Group "))
    author = F.when(n % 4 == 0, F.array(full, group)).when(n % 4 == 1, F.array(bare)).when(n % 4 == 2, F.array(group))
    date = lambda k: F.when(n % 5 == k, F.struct(F.array(F.array((1400 + n % 800).cast("int"), F.lit(5))).alias("date-parts")))
    message = F.struct(
        F.when(n % 6 != 5, F.array(F.concat(F.lit("  A &amp; B "), n))).alias("title"),
        author.alias("author"),
        *[date(k).alias(name) for k, name in enumerate(("published", "published-print", "published-online", "issued"))],
        F.when(F.col("lang").isNotNull(), F.array(F.concat(F.lit("Venue "), "lang"), F.lit("other"))).alias("container-title"),
    )
    found = table(spark, sf, "documents").select("doc_id", S.crossref(F.to_json(message)).alias("m"))
    return found.select("doc_id", "m.title", F.array_join("m.authors", "|").alias("authors"), "m.year", "m.venue")


@register("first_objects", "SELECT event_id, CASE WHEN event_id % 7 <> 6 THEN props END AS found FROM events")
def first_objects(spark: SparkSession, sf: str) -> DataFrame:
    """JSON out of a model's answer: behind what it thought, in a fence, with braces around; none where there is only a broken one."""
    said = F.when(F.col("event_id") % 7 == 6, F.lit('<think>{"a": 1}</think> {"broken": ')).otherwise(F.concat(F.lit('<think>{"a": 1}</think>Sure {here}:\n```json\n'), "props", F.lit("\n``` and } {")))
    return table(spark, sf, "events").select("event_id", S.objects(said).alias("found"))


#: How the archives of the query are made, by the remainder of the document's key.
ARCHIVES_SQL = "CASE doc_id % 7 WHEN 0 THEN 'names that differ by case alone' WHEN 1 THEN 'bad path' WHEN 2 THEN 'no archive' END"


@register(
    "archive_entries",
    f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS text, {ARCHIVES_SQL} AS error FROM documents),
good AS (SELECT doc_id, unnest(['main.tex', 'a/b.bin']) AS path, unnest([strlen(text), 3]) AS n_bytes, unnest([sha256(text), sha256('x' || chr(0) || 'y')]) AS digest, unnest([false, true]) AS is_binary FROM a WHERE error IS NULL)
SELECT doc_id, path, n_bytes, digest, is_binary, NULL AS error FROM good UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, error FROM a WHERE error IS NOT NULL""",
)
def archive_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Projects packed and read again: junk and the folder that all share go, a bad archive is refused whole."""
    n = F.col("doc_id") % 7
    main = F.when(n == 1, "p/../main.tex").otherwise("p/main.tex")
    other = F.when(n == 0, "p/MAIN.tex").otherwise("p/a/b.bin")
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    file = lambda path, data: F.struct(path.alias("path"), data.alias("data"))
    files = F.array(file(main, body), file(other, F.encode(F.lit("x\0y"), "UTF-8")), file(F.lit("__MACOSX/p/._main.tex"), body))
    packed = S.packed(table(spark, sf, "documents").select("doc_id", files.alias("files")), "doc_id", "files")
    broken = packed.select("doc_id", F.when(n == 2, F.encode(F.lit("nothing"), "UTF-8")).otherwise(F.col("archive")).alias("archive"))
    found = S.unpacked(broken, "doc_id", "archive")
    return found.select("doc_id", "path", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest"), "is_binary", "error")


MANIFESTS = ('{"main_path": "a.tex", "engine": "xelatex"}', '{"main_path": "b.bin", "engine": "lua"}', '{"main_path": 3, "engine": ["xelatex"]}', "[1]", "{", '{"engine": "pdflatex"}')


@register("manifests", "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'a.tex' END AS main, CASE page_id % 6 WHEN 0 THEN 'xelatex' WHEN 5 THEN 'pdflatex' END AS engine FROM pages")
def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """What an archive's manifest decides: a main file that is one of its texts, an engine that exists, each on its own; any defect decides nothing."""
    said = F.get(F.array(*map(F.lit, MANIFESTS)), (F.col("page_id") % 6).cast("int"))
    found = table(spark, sf, "pages").select("page_id", S.manifest(said, F.array(F.lit("a.tex"))).alias("m"))
    return found.select("page_id", "m.main", "m.engine")


@register(
    "tree_paths",
    """WITH p AS (SELECT page_id, len(coalesce(html, '')) AS n, split_part(url, '/', 3) AS host, regexp_replace(url, '^[a-z]+://', '') AS rest FROM pages),
c AS (SELECT *, list_filter(string_split(rest, '/'), lambda x: x <> '' AND x <> '.') AS s FROM p)
SELECT page_id, CASE n % 5 WHEN 0 THEN array_to_string(s, '/') WHEN 1 THEN array_to_string(list_concat(s[:len(s) - 1], ['f.tex']), '/') WHEN 2 THEN 'f.tex' END AS path FROM c""",
)
def tree_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded inputs as paths of the tree, made of the hosts and paths of pages: a sibling folder and what climbs out are refused."""
    n = F.char_length(F.coalesce("html", F.lit("")))
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    up = F.repeat(F.lit("../"), F.size(F.filter(F.split(rest, "/"), lambda x: ~x.isin("", "."))))
    recorded = F.when(n % 5 == 0, F.concat(F.lit("/tmp/r/.//"), rest)).when(n % 5 == 1, F.concat(F.lit("/tmp/r/"), rest, F.lit("/../f.tex"))).when(n % 5 == 2, F.concat(F.lit("/tmp/r/"), rest, F.lit("/"), up, F.lit("f.tex"))).when(n % 5 == 3, F.concat(F.lit("/tmp/r/"), rest, F.lit("/"), up, F.lit("../f.tex"))).otherwise(F.concat(F.lit("/tmp/rx/"), rest))
    return table(spark, sf, "pages").select("page_id", S.tree_path(recorded, F.lit("/tmp/r/")).alias("path"))


@register("mention_reconcile", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '0,1' WHEN 1 THEN '1' ELSE '0,2' END AS kept FROM conversations")
def mention_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Equal titles need an occurrence each, and a longer title takes its words from a shorter one."""
    title = F.concat(F.lit("T"), "conv_id")
    longer = F.concat(title, F.lit(" et al"))
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("@"), longer, F.lit(", @"), title, F.lit("."))).when(F.col("turn") % 3 == 1, F.concat(F.lit("ask @"), longer)).otherwise(F.concat(F.lit("@"), title, F.lit(" @"), title))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(M.reconciled(text, F.array(title, longer, title, F.lit("zzz"))).cast("array<string>"), ",").alias("kept"))


CARETS = ("'hi @'", "'hi\n@'", "'a@'", "'@x @'", "'no '", "concat('@', repeat('q', 80))")


@register(
    "caret_mention",
    f"WITH t AS (SELECT conv_id, turn, CASE turn % 6 {' '.join(f'WHEN {i} THEN {sql}' for i, sql in enumerate(CARETS))} END || 'q' || conv_id AS before FROM conversations), f AS (SELECT *, turn % 6 IN (0, 1, 3) AS hit FROM t) SELECT conv_id, turn, CASE WHEN hit THEN 'q' || conv_id END AS query, CASE WHEN hit THEN CAST(length(before) - length('q' || conv_id) - 1 AS INTEGER) END AS start, CASE WHEN hit THEN before[:length(before) - length('q' || conv_id)] || 'A title , then' END AS text, CASE WHEN hit THEN CAST(length(before) - length('q' || conv_id) + 7 + 1 AS INTEGER) END AS caret FROM f",
)
def caret_mention(spark: SparkSession, sf: str) -> DataFrame:
    """What is typed behind an @ at the caret, and the text once a title is chosen."""
    before = F.concat(F.get(F.array(*map(F.expr, CARETS)), (F.col("turn") % 6).cast("int")), F.lit("q"), "conv_id")
    at = F.char_length("before")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", before.alias("before")).withColumn("text", F.concat("before", F.lit(", then")))
    found = rows.withColumn("m", M.mention_query(F.col("text"), at))
    put = found.withColumn("p", M.mention_inserted(F.col("text"), F.col("m.start"), at, F.lit("A title")))
    return put.select("conv_id", "turn", "m.query", "m.start", "p.text", "p.caret")


@register("author_sets", "WITH v AS (SELECT CASE c_custkey % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' WHEN 2 THEN 'missed' WHEN 3 THEN 'hallucinated' ELSE 'correct' END AS verdict FROM customer) SELECT verdict, count(*) AS n FROM v GROUP BY verdict")
def author_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Author lists as sets of folded names, whatever their order, marks and case."""
    n = F.col("c_custkey") % 5
    truth = F.when(n != 3, F.when(n == 4, F.array(F.lit(" "))).otherwise(F.array("c_name", F.lit("Zoë  Çelik"))))
    got = F.when(n == 0, F.array(F.lit("ZOE CELIK"), F.col("c_name"), F.lower("c_name"))).when(n == 1, F.array("c_name")).when(n == 3, F.array("c_name"))
    rows = table(spark, sf, "customer").select("c_custkey", truth.alias("truth"), got.alias("got"))
    named = lambda side: rows.select("c_custkey", F.lit(side).alias("side"), F.explode(side).alias("name"))
    names = named("truth").unionByName(named("got")).withColumn("name", metadata_keyed("name"))
    return ev.name_sets(rows.select("c_custkey"), names, "c_custkey").groupBy("verdict").agg(F.count("*").alias("n"))


@register("resolver_verdicts", "SELECT page_id, page_id % 6 IN (0, 3, 4) AS passed FROM pages")
def resolver_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """A resolution passes if every expected title takes one of its own and none is left; nothing expected, nothing resolved."""
    name = F.concat(F.lit("Title "), "page_id")
    cases = (
        ((name, F.lit("graph")), (F.lit("On GRAPHS"), F.upper(name))),  # any order and case
        ((name,), (name, F.lit("other"))),  # one too many
        ((F.lit("graph"), F.lit("graph")), (F.lit("Graph theory"), name)),  # one title cannot serve twice
        ((F.lit("graph"), F.lit("graph")), (F.lit("Graph theory"), F.lit("Graphs"))),
        ((), ()),
        ((), (name,)),
    )
    strings = lambda xs: F.array(*xs).cast("array<string>")
    pick = lambda side: F.get(F.array(*[strings(c[side]) for c in cases]), (F.col("page_id") % 6).cast("int"))
    return table(spark, sf, "pages").select("page_id", ev.resolution_passes(pick(0), pick(1)).alias("passed"))


@register("golden_cases", "SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 4 = 3 THEN 'off_topic' ELSE 'content' END AS kind, CASE WHEN item_id % 4 = 3 THEN '' ELSE concat('n', item_id, '|end') END AS needles FROM benchmark")
def golden_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases made of the benchmark's items, checked as a set is when it is read."""
    off = F.col("item_id") % 4 == 3
    needles = F.when(~off, F.array(F.concat(F.lit(" n"), "item_id", F.lit(" ")), F.lit("end")))
    cases = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.when(off, "off_topic").otherwise("content").alias("kind"), F.concat(F.lit("Is it "), "text").alias("question"), F.lit(None).cast("string").alias("paper_title_contains"), needles.alias("expect_substrings"))
    return S.checked_cases(cases).select("id", "kind", F.array_join("expect_substrings", "|").alias("needles"))


@register("main_files", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'paper.tex' WHEN 1 THEN 'z.tex' WHEN 2 THEN 'a/b.tex' END AS main, CASE page_id % 5 WHEN 3 THEN 'none' WHEN 4 THEN 'ambiguous' ELSE 'ok' END AS verdict, CASE page_id % 5 WHEN 0 THEN 'xelatex' WHEN 1 THEN 'pdflatex' WHEN 2 THEN 'pdflatex' END AS engine FROM pages")
def main_files(spark: SparkSession, sf: str) -> DataFrame:
    """The file that a tree compiles, and its engine: by a usual name, by depth, by being the only one that is no quotation."""
    real, quoted = "\\documentclass{article}\n", "\\begin{verbatim}\n\\documentclass{x}\n\\end{verbatim}\n% \\documentclass{y}\n"
    trees = (
        (("b.tex", real), ("paper.tex", real + "\\usepackage[a]{xcolor, fontspec }")),
        (("z.tex", real + "%\\usepackage{fontspec}"), ("x/a.tex", real), ("x/b.tex", real)),
        (("a/b.tex", real), ("main.tex", quoted)),
        (("main.tex", quoted), ("notes.txt", real)),
        (("main.tex", real), ("ms.tex", real)),
    )
    file = lambda f: F.struct(F.lit(f[0]).alias("path"), F.lit(f[1]).alias("text"))
    files = F.get(F.array(*[F.array(*map(file, t)) for t in trees]), (F.col("page_id") % len(trees)).cast("int"))
    tree = table(spark, sf, "pages").select("page_id", F.inline(files))
    chosen = S.main_files(tree, "page_id")
    texts = tree.select("page_id", F.col("path").alias("main"), S.engine(F.col("text")).alias("engine"))
    return chosen.join(texts, ["page_id", "main"], "left").select("page_id", "main", "verdict", "engine")


@register(
    "first_errors",
    """WITH d AS (SELECT doc_id, text, n_chars, split_part(text, ' ', 1) AS w FROM documents WHERE text IS NOT NULL),
logs AS (SELECT doc_id, 'This is TeX' || chr(10) || text || chr(10) || CASE n_chars % 3 WHEN 0 THEN './' || w || '.tex:' || n_chars || ': Undefined ' || w || ' ' WHEN 1 THEN '! Emergency ' || w ELSE 'all is well' END || chr(10) || '! late' AS log FROM d),
lines AS (SELECT doc_id, unnest(string_split(log, chr(10))) AS l, unnest(range(len(string_split(log, chr(10))))) AS k FROM logs),
said AS (SELECT doc_id, k, coalesce(CASE WHEN NOT regexp_matches(l, '^[ \t\n\v\f\r]') AND regexp_matches(l[2:], ':[0-9]+:') THEN nullif(trim(regexp_extract(l[2:], ':[0-9]+:(.*)$', 1)), '') END, CASE WHEN starts_with(l, '!') THEN nullif(trim(l[2:]), '') END) AS message FROM lines)
SELECT doc_id, arg_min(message, k) FILTER (WHERE message IS NOT NULL) AS message FROM said GROUP BY doc_id""",
)
def first_errors(spark: SparkSession, sf: str) -> DataFrame:
    """What a TeX log says first: with its file and line, or without. The log is what a document has printed and a line made of its first word and length."""
    d = table(spark, sf, "documents").where("text is not null")
    n, w = F.col("n_chars"), F.split_part("text", F.lit(" "), F.lit(1))
    last = F.when(n % 3 == 0, F.concat(F.lit("./"), w, F.lit(".tex:"), n, F.lit(": Undefined "), w, F.lit(" "))).when(n % 3 == 1, F.concat(F.lit("! Emergency "), w)).otherwise("all is well")
    return d.select("doc_id", S.first_error(F.array_join(F.array(F.lit("This is TeX"), F.col("text"), last, F.lit("! late")), "\n")).alias("message"))


@register("synctex_records", "SELECT page_id, record, CASE record WHEN 1 THEN concat('a', page_id, '.pdf') ELSE 'b.pdf' END AS output, CASE record WHEN 1 THEN '1' END AS page FROM pages, (SELECT unnest([CAST(1 AS BIGINT), CAST(2 AS BIGINT)]) AS record)")
def synctex_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of lines; what stands before the first is none, and a field's first value counts."""
    text = F.concat(F.lit("Page:0\nSyncTeX result begin\nOutput:a"), "page_id", F.lit(".pdf\nPage:1\nPage:2\nOutput:b.pdf\nend"))
    found = S.synctex_records(table(spark, sf, "pages").select("page_id", text.alias("text")), "page_id")
    return found.select("page_id", "record", F.col("fields")["Output"].alias("output"), F.col("fields")["Page"].alias("page"))
