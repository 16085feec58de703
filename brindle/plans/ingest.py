"""Queries of ingest: chunks, captions, page metadata, catalogs, staleness, upserts, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.bindings import PAPERS_SQL, WORDS_SQL, papers, table
from brindle.config import CONFIG as C
from brindle.functions import text as X
from brindle.operators import keyed, lexical
from brindle.operators.resolve import title_spans
from brindle.registry import register
from brindle.store import in_order

STEP = C.chunk_words - C.chunk_overlap
WINDOWS_SQL = f"w AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents), chunked AS (SELECT doc_id, unnest(range(0, CAST(greatest(0, ceil((len(w) - {C.chunk_words}) / CAST({STEP} AS DOUBLE))) AS BIGINT) + 1)) AS chunk_index, w FROM w WHERE len(w) > 0), chunk_texts AS (SELECT doc_id, chunk_index, array_to_string(w[chunk_index * {STEP} + 1 : chunk_index * {STEP} + {C.chunk_words}], ' ') AS chunk FROM chunked)"


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(X.windows(F.col("text"), C.chunk_words, C.chunk_overlap)).alias("chunk_index", "chunk")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@register("chunk_windows", f"WITH {WINDOWS_SQL} SELECT doc_id, chunk_index, md5(chunk) AS chunk_md5, CAST(len(chunk) AS INTEGER) AS chars FROM chunk_texts")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_rows(spark, sf).select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"), F.char_length("chunk").alias("chars"))


@register("chunk_counts", f"WITH {WINDOWS_SQL} SELECT d.source AS project_id, count(c.doc_id) AS chunks, count(DISTINCT d.doc_id) AS papers FROM documents d LEFT JOIN chunk_texts c ON c.doc_id = d.doc_id GROUP BY d.source")
def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(X.windows(F.col("text"), C.chunk_words, C.chunk_overlap)).cast("long")
    return table(spark, sf, "documents").groupBy(F.col("source").alias("project_id")).agg(F.sum(n).alias("chunks"), F.count("*").alias("papers"))


@register("chunk_lookup", f"WITH {WINDOWS_SQL} SELECT c.doc_id, c.chunk_index, md5(c.chunk) AS chunk_md5 FROM chunk_texts c JOIN labels l ON l.doc_id = c.doc_id AND l.quality = c.chunk_index")
def chunk_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Point reads of (paper, index): only the wanted window is cut from a text."""
    wanted = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("chunk_index"))
    rows = table(spark, sf, "documents").select("doc_id", "text").join(wanted, "doc_id")
    return rows.select("doc_id", "chunk_index", F.get(X.windows(F.col("text"), C.chunk_words, C.chunk_overlap), F.col("chunk_index").cast("int")).alias("chunk")).where("chunk is not null").select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


CAPTION_SQL = "concat('Seen. Figure ', doc_id, ': ', left(regexp_replace(text, '\\s+', ' ', 'g'), 40), chr(10), 'fig 7 - short', chr(10), text)"


@register("caption_chunks", f"SELECT doc_id, trim(c) AS caption FROM (SELECT doc_id, unnest(regexp_extract_all({CAPTION_SQL}, '(?i)(?:Figure|Fig\\.?)\\s+\\d+[.:—-]?\\s+\\S[^\\n]{{4,300}}')) AS c FROM documents)")
def caption_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The texts have no captions of their own, so two are put in front of each."""
    body = F.concat(F.lit("Seen. Figure "), F.col("doc_id").cast("string"), F.lit(": "), F.left(F.regexp_replace("text", r"\s+", " "), F.lit(40)), F.lit("\nfig 7 - short\n"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.explode(X.captions(body)).alias("caption"))


@register(
    "html_title",
    "WITH h AS (SELECT page_id, split_part(html, '</head>', 1) AS h FROM pages), t AS (SELECT page_id, trim(regexp_extract(left(h, 200000), '(?i)<title[^>]*>([^<]+)</title>', 1)) AS t FROM h) SELECT page_id, nullif(left(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), 300), '') AS title FROM t",
)
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.html_title(X.head_of_page(F.col("html"))).alias("title"))


VARIANTS_SQL = "v AS (SELECT page_id * 3 AS pos, url, concat('S', page_id, '.') AS summary FROM pages UNION ALL SELECT page_id * 3 + 1, concat('HTTPS://www.', split_part(url, '://', 2), '/'), concat('S', page_id, '.') FROM pages UNION ALL SELECT page_id * 3 + 2, split_part(url, '://', 2), CASE WHEN page_id % 5 = 0 THEN concat(page_id, '.') ELSE concat('T', page_id % 2, '.') END FROM pages)"
NORM_SQL = "regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^.*?://', ''), '^www\\.', ''), '/+$', '')"


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's address in three spellings, so that there is something to merge; every fifth page's last summary stands within its first."""
    pages = table(spark, sf, "pages")
    rest = F.split_part("url", F.lit("://"), F.lit(2))
    named = lambda i, url, summary: F.struct((F.col("page_id") * 3 + i).alias("pos"), url.alias("url"), summary.alias("summary"))
    own = F.concat(F.lit("S"), F.col("page_id").cast("string"), F.lit("."))
    return pages.select(F.inline(F.array(named(0, F.col("url"), own), named(1, F.concat(F.lit("HTTPS://www."), rest, F.lit("/")), own), named(2, rest, F.when(F.col("page_id") % 5 == 0, F.concat(F.col("page_id").cast("string"), F.lit("."))).otherwise(F.concat(F.lit("T"), (F.col("page_id") % 2).cast("string"), F.lit(".")))))))


def source_catalog(rows: DataFrame) -> DataFrame:
    """Rows (key, n, url, summary): sources by canonical address, numbered in order of appearance, with the summaries that add something.

    A summary that stands within what is there already adds nothing. Numbers come
    from sorted ranges, so no window covers all sources.
    """
    keyed_rows = rows.withColumn("key", X.canonical_url(F.col("url"))).where("key <> ''")
    grouped = keyed_rows.groupBy("key").agg(F.min(F.struct("pos", "url")).alias("first"), F.array_sort(F.collect_set(F.struct("pos", "summary"))).alias("all"))
    merged = F.aggregate("all", F.lit(""), lambda s, x: F.when(F.coalesce(F.contains(s, x["summary"]), F.lit(True)), s).otherwise(F.trim(F.concat_ws(" ", F.nullif(s, F.lit("")), x["summary"]))))
    flat = in_order(grouped.select("key", "first.pos", "first.url", merged.alias("summary")), ["pos"], "n")
    return flat.select("key", (F.col("n") + 1).alias("n"), "url", "summary")


@register(
    "url_canonical_catalog",
    f"WITH {VARIANTS_SQL}, k AS (SELECT *, {NORM_SQL} AS key FROM v), f AS (SELECT key, min(pos) AS pos, count(*) AS spellings FROM k WHERE key <> '' GROUP BY key), s AS (SELECT k.key, k.summary, min(k.pos) AS pos FROM k GROUP BY k.key, k.summary), m AS (SELECT key, string_agg(summary, ' ' ORDER BY pos) AS summary FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.key = s.key AND t.pos < s.pos AND contains(t.summary, s.summary)) GROUP BY key) SELECT f.key, row_number() OVER (ORDER BY f.pos) AS n, k.url, m.summary FROM f JOIN k ON k.pos = f.pos JOIN m ON m.key = f.key",
)
def url_canonical_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return source_catalog(findings(spark, sf))


@register("stale_papers_anti", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def stale_papers_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Papers that have not been indexed."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@register("stale_messages_null_safe", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS DISTINCT FROM 1")
def stale_messages_null_safe(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose model is not the current one, absent ones included."""
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.where(~F.col("quality").eqNullSafe(1))


@register("model_counts", "SELECT label AS model, count(*) AS n FROM embeddings GROUP BY label")
def model_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("model")).agg(F.count("*").alias("n"))


@register("embeddings_stale_sum", "SELECT (SELECT count(*) FROM embeddings WHERE label <> 3) + (SELECT count(*) FROM labels WHERE quality <> 1) AS stale")
def embeddings_stale_sum(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "embeddings").where("label <> 3").agg(F.count("*").alias("a"))
    b = table(spark, sf, "labels").where("quality <> 1").agg(F.count("*").alias("b"))
    return a.crossJoin(b).select((F.col("a") + F.col("b")).alias("stale"))


@register("needle_satisfies", "SELECT d.doc_id AS doc, b.item_id AS needle FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def needle_satisfies(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.anchored_contains(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text")


@register("case_status", "SELECT b.item_id, count(d.doc_id) AS papers, CASE count(d.doc_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def case_status(spark: SparkSession, sf: str) -> DataFrame:
    """A case can be scored only if exactly one paper holds its passage; the others are told apart."""
    found = needle_satisfies(spark, sf).groupBy(F.col("needle").alias("item_id")).agg(F.count("*").alias("papers"))
    rows = table(spark, sf, "benchmark").select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("papers", F.lit(0)).alias("papers"))
    return rows.withColumn("status", F.when(F.col("papers") == 0, "missing").when(F.col("papers") == 1, "ok").otherwise("ambiguous"))


@register("squeezed_contains", "SELECT b.item_id, count(d.doc_id) AS n FROM benchmark b LEFT JOIN documents d ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) GROUP BY b.item_id")
def squeezed_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Containment that does not mind how lines are wrapped."""
    docs = table(spark, sf, "documents").select("doc_id", X.squeezed(F.col("text")).alias("text"))
    items = table(spark, sf, "benchmark").select("item_id", X.squeezed(F.col("text")).alias("text"))
    found = keyed.anchored_contains(docs, items, "doc_id", "text", "item_id", "text").groupBy(F.col("needle").alias("item_id")).agg(F.count("*").alias("n"))
    return items.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))


@register("index_replace", f"WITH {WINDOWS_SQL}, old AS (SELECT doc_id, chunk_index, md5(chunk) AS h FROM chunk_texts), fresh AS (SELECT o.doc_id, o.chunk_index, concat(o.h, '2') AS h FROM old o JOIN labels l ON l.doc_id = o.doc_id WHERE l.quality = 1) SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT * FROM fresh")
def index_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled papers are indexed anew; those of low quality have no chunks any more."""
    old = chunk_rows(spark, sf).select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("h"))
    labels = table(spark, sf, "labels")
    fresh = old.join(labels.where("quality = 1").select("doc_id"), "doc_id").withColumn("h", F.concat("h", F.lit("2")))
    return keyed.replace_groups(old, fresh, labels, "doc_id")


@register("message_upsert", "WITH base AS (SELECT doc_id, n_chars AS v FROM documents), new AS (SELECT user_id AS doc_id, CAST(arg_max(event_id, event_id) AS BIGINT) AS v FROM events GROUP BY user_id) SELECT coalesce(n.doc_id, b.doc_id) AS doc_id, coalesce(n.v, b.v) AS v FROM base b FULL OUTER JOIN new n ON n.doc_id = b.doc_id")
def message_upsert(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("v"))
    new = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("v"), F.col("event_id").alias("seq"))
    return keyed.upsert(base, new, ["doc_id"], "seq")


@register("seed_missing", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r.r_regionkey + 20, concat('seed ', r.r_name) FROM region r WHERE r.r_regionkey + 20 NOT IN (SELECT n_nationkey FROM nation)")
def seed_missing(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    new = table(spark, sf, "region").select((F.col("r_regionkey") + 20).cast("int").alias("k"), F.concat(F.lit("seed "), "r_name").alias("name"))
    return keyed.insert_missing(base, new, ["k"])


@register("backfill_sizes", "SELECT doc_id, concat('main-', doc_id, '.tex') AS path, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents")
def backfill_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("main-"), F.col("doc_id").cast("string"), F.lit(".tex")).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"))


@register("metadata_snippets", "SELECT doc_id, CAST(len(trim(left(text, 3000))) AS INTEGER) AS chars, CASE WHEN lang = 'en' THEN 'crossref' WHEN n_chars > 500 THEN 'llm' ELSE 'none' END AS label FROM documents")
def metadata_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """What an extractor would be shown of each text (its contract is the first 3000 characters), and which source wins."""
    label = F.when(F.col("lang") == "en", "crossref").when(F.col("n_chars") > 500, "llm").otherwise("none")
    return table(spark, sf, "documents").select("doc_id", F.char_length(F.trim(F.left("text", F.lit(3000)))).alias("chars"), label.alias("label"))


@register("conversation_markdown", "SELECT conv_id, concat('# Conversation ', conv_id, chr(10), chr(10), string_agg(concat(CASE role WHEN 'user' THEN '## You' ELSE '## Assistant' END, chr(10), chr(10), trim(text)), concat(chr(10), chr(10)) ORDER BY turn, role, text), chr(10)) AS markdown FROM conversations GROUP BY conv_id")
def conversation_markdown(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    part = lambda m: F.concat(F.when(m["role"] == "user", "## You").otherwise("## Assistant"), F.lit("\n\n"), F.trim(m["text"]))
    grouped = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("m"))
    return grouped.select("conv_id", F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("m", part), "\n\n"), F.lit("\n")).alias("markdown"))


TREE_SQL = "tree AS (SELECT page_id, regexp_replace(split_part(url, '://', 2), '[?#].*$', '') AS path, CAST(len(html) AS BIGINT) AS size_bytes FROM pages)"


def tree(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(F.split_part("url", F.lit("://"), F.lit(2)), "[?#].*$", "").alias("path"), F.char_length("html").cast("long").alias("size_bytes"))


@register("tree_rollup", f"WITH {TREE_SQL}, a AS (SELECT unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS dir, size_bytes FROM tree) SELECT dir, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) AS files FROM a GROUP BY dir")
def tree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = tree(spark, sf).select(F.explode(keyed.ancestors(F.col("path"))).alias("dir"), "size_bytes")
    return rows.groupBy("dir").agg(F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("files"))


@register("tree_order", f"WITH {TREE_SQL}, n AS (SELECT DISTINCT regexp_replace(path, '/.*$', '') AS name, contains(path, '/') AS is_dir FROM tree) SELECT name, CASE WHEN is_dir THEN 'dir' ELSE 'file' END AS kind, row_number() OVER (PARTITION BY is_dir ORDER BY lower(name), name) AS pos FROM n")
def tree_order(spark: SparkSession, sf: str) -> DataFrame:
    """Entries at the top: directories before files, names without regard to case, numbered within their kind."""
    rows = tree(spark, sf).select(F.regexp_replace("path", "/.*$", "").alias("name"), F.when(F.contains("path", F.lit("/")), "dir").otherwise("file").alias("kind")).distinct()
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("kind").orderBy(F.lower("name"), "name")).cast("long"))


DIGEST_FILES = 1024


@register("tree_digest", f"WITH e AS (SELECT source, doc_id, sha256(text) AS h FROM documents), b AS (SELECT source, doc_id // {DIGEST_FILES} AS block, sha256(string_agg(concat(doc_id, chr(1), h), chr(1) ORDER BY doc_id)) AS d FROM e GROUP BY source, doc_id // {DIGEST_FILES}) SELECT source, sha256(concat('pdflatex', chr(1), 'main.tex', chr(1), string_agg(d, chr(1) ORDER BY block))) AS digest FROM b GROUP BY source")
def tree_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of a set of files in order of their path: of blocks of files first, then of the blocks' digests; contents are never gathered."""
    each = table(spark, sf, "documents").select("source", F.floor(F.col("doc_id") / DIGEST_FILES).alias("block"), "doc_id", F.sha2("text", 256).alias("h"))
    joined = lambda rows, shown: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*rows))), shown), "\x01")
    blocks = each.groupBy("source", "block").agg(F.sha2(joined(["doc_id", "h"], lambda x: F.concat(x["doc_id"].cast("string"), F.lit("\x01"), x["h"])), 256).alias("d"))
    return blocks.groupBy("source").agg(F.sha2(F.concat(F.lit("pdflatex\x01main.tex\x01"), joined(["block", "d"], lambda x: x["d"])), 256).alias("digest"))


@register("skip_loaded", f"WITH {PAPERS_SQL} SELECT p.paper_id, p.project_id, p.title FROM papers p WHERE p.paper_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def skip_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a bulk load that are not there yet."""
    loaded = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("paper_id"))
    return papers(spark, sf).select("paper_id", "project_id", "title").join(loaded, "paper_id", "left_anti")


SPANS_SQL = f"""{PAPERS_SQL}, t AS (SELECT paper_id, list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM papers), q AS (SELECT item_id, concat(' ', array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), ' '), ' ') AS q FROM benchmark),
n AS (SELECT paper_id, t, unnest(range(least(4, len(t)), len(t) + 1)) AS n FROM t WHERE len(t) > 0), s AS (SELECT paper_id, n, i, array_to_string(t[i + 1 : i + n], ' ') AS span FROM (SELECT paper_id, t, n, unnest(range(0, len(t) - n + 1)) AS i FROM n)),
hit AS (SELECT q.item_id, s.paper_id, s.span, s.n, s.i FROM q JOIN s ON contains(q.q, concat(' ', s.span, ' '))), best AS (SELECT item_id, paper_id, span, n FROM hit QUALIFY row_number() OVER (PARTITION BY item_id, paper_id ORDER BY n DESC, i) = 1)"""


@register("title_span_resolve", f"WITH {SPANS_SQL} SELECT b.item_id AS question_id, b.paper_id, b.span, b.n, count(*) OVER (PARTITION BY b.item_id, b.span) > 1 AS ambiguous FROM best b")
def title_span_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Papers whose title a question quotes; a run that several papers claim is ambiguous."""
    titled = papers(spark, sf).select("paper_id", lexical.tokens(F.col("title")).alias("words"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), lexical.tokens(F.col("text")).alias("words"))
    found = title_spans(asked, titled)
    return found.withColumn("ambiguous", F.count("*").over(Window.partitionBy("question_id", "span")) > 1)


@register("highlight_terms", "WITH t AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: len(x) >= 4 AND x NOT IN ('that', 'with', 'from', 'this'))) AS term FROM benchmark) SELECT DISTINCT item_id, term, CAST(len(term) AS INTEGER) AS chars FROM t")
def highlight_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9_]+"), lambda x: (F.length(x) >= 4) & ~x.isin("that", "with", "from", "this")))
    return table(spark, sf, "benchmark").select("item_id", F.explode(terms).alias("term")).withColumn("chars", F.length("term"))


@register(
    "highlighted_items",
    "WITH t AS (SELECT item_id, text, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: len(x) >= 4))) AS ts FROM benchmark), s AS (SELECT item_id, text, list_distinct(list_concat(ts[1:3], list_transform(ts[1:2], lambda x: x[1:3]))) AS ts FROM t), o AS (SELECT item_id, text, (SELECT string_agg(x, '|' ORDER BY len(x) DESC, x) FROM (SELECT unnest(ts) AS x)) AS p FROM s) SELECT item_id, CASE WHEN p IS NULL THEN text ELSE regexp_replace(text, '(' || p || ')', '<mark>\\1</mark>', 'gi') END AS shown FROM o",
)
def highlighted_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each item with some of its words marked, and with beginnings of them that must give way to the longer ones."""
    ts = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9_]+"), lambda x: F.length(x) >= 4)))
    rows = table(spark, sf, "benchmark").select("item_id", "text", ts.alias("ts"))
    terms = F.array_distinct(F.concat(F.slice("ts", 1, 3), F.transform(F.slice("ts", 1, 2), lambda x: F.left(x, F.lit(3)))))
    return rows.select("item_id", X.highlighted(F.col("text"), terms).alias("shown"))


@register("short_needles", "WITH w AS (SELECT DISTINCT lower(x) AS w FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS x FROM benchmark) WHERE len(x) >= 6), d AS (SELECT doc_id, text FROM documents) SELECT w AS needle, count(*) AS docs FROM d JOIN w ON contains(d.text, w.w) GROUP BY w")
def short_needles(spark: SparkSession, sf: str) -> DataFrame:
    """In how many documents each longer word of the benchmark stands, also within other words: needles too short for whole words within."""
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda x: F.length(x) >= 6)
    needles = table(spark, sf, "benchmark").select(F.explode(words).alias("w")).select(F.lower("w").alias("w")).distinct().select("w", F.col("w").alias("wanted"))
    return keyed.anchored_contains(table(spark, sf, "documents"), needles, "doc_id", "text", "w", "wanted").groupBy("needle").agg(F.count("*").alias("docs"))


@register("paper_prompt_lines", f"WITH {PAPERS_SQL} SELECT paper_id, concat_ws(' — ', nullif(title, ''), CASE WHEN lang <> 'en' THEN lang END, project_id) AS line FROM papers")
def paper_prompt_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One line for each paper; absent fields are left out."""
    return papers(spark, sf).select("paper_id", F.concat_ws(" — ", F.nullif("title", F.lit("")), F.when(F.col("lang") != "en", F.col("lang")), "project_id").alias("line"))


@register("embed_batches", f"SELECT doc_id // {C.embed_batch} AS batch, count(*) AS n, CAST(sum(len(concat('search_document: ', ltrim(text)))) AS BIGINT) AS chars FROM documents GROUP BY doc_id // {C.embed_batch}")
def embed_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with their task's prefix, in batches of bounded size."""
    shown = F.concat(F.lit("search_document: "), F.ltrim("text"))
    return table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / C.embed_batch).alias("batch")).agg(F.count("*").alias("n"), F.sum(F.char_length(shown).cast("long")).alias("chars"))



#: A path that is the export's own and that nobody may write or delete.
RESERVED = "manifest.json"


@register("delete_paths", f"WITH {TREE_SQL}, asked AS (SELECT DISTINCT CASE WHEN page_id % 4 = 0 THEN path WHEN page_id % 4 = 1 THEN concat(path, '/none') ELSE '{RESERVED}' END AS path FROM tree), k AS (SELECT DISTINCT path FROM tree) SELECT a.path, CASE WHEN a.path = '{RESERVED}' THEN 'refused' WHEN k.path IS NOT NULL THEN 'deleted' ELSE 'missing' END AS outcome FROM asked a LEFT JOIN k ON k.path = a.path")
def delete_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Each path that is to go and what comes of it: a missing one is no error, the reserved one is refused."""
    files = tree(spark, sf).select("page_id", "path")
    asked = files.select(F.when(F.col("page_id") % 4 == 0, F.col("path")).when(F.col("page_id") % 4 == 1, F.concat("path", F.lit("/none"))).otherwise(RESERVED).alias("path")).distinct()
    known = files.select("path", F.lit(True).alias("there")).distinct()
    outcome = F.when(F.col("path") == RESERVED, "refused").when(F.col("there"), "deleted").otherwise("missing")
    return asked.join(known, "path", "left").select("path", outcome.alias("outcome"))


@register("compile_memo", "WITH r AS (SELECT sha256(text) AS h, min(doc_id) AS result FROM documents WHERE doc_id % 2 = 0 GROUP BY sha256(text)) SELECT d.doc_id, r.result IS NOT NULL AS cached, r.result FROM documents d LEFT JOIN r ON r.h = sha256(d.text)")
def compile_memo(spark: SparkSession, sf: str) -> DataFrame:
    """Results are looked up by a digest of the contents: texts of even ids have been made, and their copies need not be made again."""
    hashed = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    made = hashed.where(F.col("doc_id") % 2 == 0).groupBy("h").agg(F.min("doc_id").alias("result"))
    return hashed.join(made, "h", "left").select("doc_id", F.col("result").isNotNull().alias("cached"), "result")


@register("canvas_scale", "SELECT doc_id, CAST(n_chars % 612 AS DOUBLE) * 1.5 AS canvas_x, CAST(n_chars % 612 AS DOUBLE) * 1.5 / 1.5 AS tex_x FROM documents")
def canvas_scale(spark: SparkSession, sf: str) -> DataFrame:
    """A place on a page in points, as a place on a canvas of one and a half times its size, and back."""
    point = (F.col("n_chars") % 612).cast("double")
    return table(spark, sf, "documents").select("doc_id", (point * 1.5).alias("canvas_x"), (point * 1.5 / 1.5).alias("tex_x"))
