"""Relational queries of a shared library: scopes, roles, access, pages, roll-ups, guarded writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.bindings import table
from brindle.config import CONFIG as C
from brindle.functions import text as X
from brindle.operators import keyed
from brindle.plans.ingest import TREE_SQL, tree
from brindle.operators.scan import running
from brindle.registry import register
from brindle.store import hinted

#: Segments stand for roles, and roles have ranks.
ROLES = {"BUILDING": "owner", "MACHINERY": "member"}
RANKS = {"member": 0, "owner": 1}


def role(segment):
    return F.create_map(*[F.lit(x) for k, v in ROLES.items() for x in (k, v)])[segment]


def rank(named):
    """An unknown role ranks below all."""
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in RANKS.items() for x in (k, v)])[named], F.lit(-1))


ROLE_SQL = "CASE c_mktsegment WHEN 'BUILDING' THEN 'owner' WHEN 'MACHINERY' THEN 'member' END"
RANK_SQL = f"coalesce(CASE {ROLE_SQL} WHEN 'member' THEN 0 WHEN 'owner' THEN 1 END, -1)"


@register("project_scan", "SELECT source AS project_id, count(*) AS papers, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS used, CAST(coalesce(sum(CASE WHEN doc_id % 7 <> 0 THEN n_chars END), 0) AS BIGINT) AS used_excluding FROM documents GROUP BY source")
def project_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Papers of every tenant and what they take, with and without excluded ones; only three columns are read."""
    sums = F.coalesce(F.sum("n_chars"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("doc_id") % 7 != 0, F.col("n_chars"))), F.lit(0))
    return table(spark, sf, "documents").groupBy(F.col("source").alias("project_id")).agg(F.count("*").alias("papers"), sums[0].alias("used"), sums[1].alias("used_excluding"))


@register("tenant_scan", "SELECT doc_id, source, lang, n_chars FROM documents WHERE source = 'src3'")
def tenant_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One tenant's rows without their texts: the predicate and the columns reach the scan."""
    return table(spark, sf, "documents").where(F.col("source") == "src3").select("doc_id", "source", "lang", "n_chars")


@register("json_scope_join", "WITH s AS (SELECT DISTINCT unnest(CAST('[\"src1\",\"src2\",\"src1\"]' AS JSON)::VARCHAR[]) AS project_id) SELECT d.source AS project_id, count(*) AS n FROM documents d JOIN s ON s.project_id = d.source GROUP BY d.source")
def json_scope_join(spark: SparkSession, sf: str) -> DataFrame:
    """A scope handed over as JSON; an id that is named twice does not double rows."""
    scope = spark.range(1).select(F.explode(F.from_json(F.lit('["src1","src2","src1"]'), "array<string>")).alias("project_id")).distinct()
    return table(spark, sf, "documents").select(F.col("source").alias("project_id")).join(hinted(scope, 10_000), "project_id").groupBy("project_id").agg(F.count("*").alias("n"))


@register("mention_ids_validate", "WITH w AS (SELECT conv_id, list(turn * 400 + conv_id ORDER BY turn) AS ids FROM conversations GROUP BY conv_id), e AS (SELECT conv_id, unnest(list_distinct(ids)) AS id FROM w) SELECT e.conv_id, count(*) AS asked, count(d.doc_id) AS found, count(*) = count(d.doc_id) AS ok FROM e LEFT JOIN documents d ON d.doc_id = e.id GROUP BY e.conv_id")
def mention_ids_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Every id that a turn names must exist; all are looked up in one join."""
    asked = table(spark, sf, "conversations").select("conv_id", (F.col("turn") * 400 + F.col("conv_id")).alias("id")).distinct()
    known = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("one"))
    rows = asked.join(known, "id", "left").groupBy("conv_id").agg(F.count("*").alias("asked"), F.count("one").alias("found"))
    return rows.withColumn("ok", F.col("asked") == F.col("found"))


@register("has_pdf", "SELECT d.doc_id, l.doc_id IS NOT NULL AS has_pdf FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def has_pdf(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "labels").select("doc_id").distinct().withColumn("has", F.lit(True))
    return table(spark, sf, "documents").select("doc_id").join(keys, "doc_id", "left").select("doc_id", F.coalesce("has", F.lit(False)).alias("has_pdf"))


@register("search_box", "SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(chr(10), nullif(p_name, ''), nullif(p_type, ''))), 'red') AND contains(lower(concat_ws(chr(10), nullif(p_name, ''), nullif(p_type, ''))), 'econ')")
def search_box(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(X.matches_search(F.lit("  Red ECON "), F.col("p_name"), F.col("p_type"))).select("p_partkey", "p_name")


@register("typeahead", "SELECT p_partkey, p_name, CAST(instr(lower(p_name), 'in') AS INTEGER) AS pos FROM part WHERE instr(lower(p_name), 'in') > 0 ORDER BY pos, p_name, p_partkey LIMIT 8")
def typeahead(spark: SparkSession, sf: str) -> DataFrame:
    """The eight best suggestions are the feature; earliest place first."""
    at = F.instr(F.lower("p_name"), "in")
    return table(spark, sf, "part").select("p_partkey", "p_name", at.alias("pos")).where("pos > 0").orderBy("pos", "p_name", "p_partkey").limit(8)


INTENT_SQL = "regexp_matches(coalesce(text, ''), '(?i)(?:^|[^a-z0-9_])(?:" + "|".join(X.METADATA_WORDS) + ")|(?:^|[^a-z0-9_])(?:19|20)[0-9]{2}(?:$|[^a-z0-9_])')"


@register("metadata_intent", f"WITH u AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT c.conv_id, c.turn, {INTENT_SQL.replace('text', 'c.text')} OR (SELECT {INTENT_SQL.replace('text', 'u.text')} FROM u WHERE u.conv_id = c.conv_id) AS needs FROM conversations c WHERE c.role = 'assistant'")
def metadata_intent(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a turn, or else the conversation's latest user turn, asks for authors, years or venues."""
    rows = table(spark, sf, "conversations")
    latest = rows.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_user")).select("conv_id", X.metadata_intent(F.col("last_user")).alias("user_needs"))
    return rows.where("role = 'assistant'").join(latest, "conv_id", "left").select("conv_id", "turn", (X.metadata_intent(F.col("text")) | F.col("user_needs")).alias("needs"))


@register("last_user_turn", "SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user FROM conversations")
def last_user_turn(spark: SparkSession, sf: str) -> DataFrame:
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(before).alias("last_user"))


@register("recent_context", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations QUALIFY r <= 6) SELECT conv_id, string_agg(concat('[', upper(role), ']: ', left(text, 300)), chr(10) ORDER BY turn) AS context FROM r GROUP BY conv_id")
def recent_context(spark: SparkSession, sf: str) -> DataFrame:
    """The last six messages of a conversation, each cut to 300 characters as the prompt's contract asks."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = table(spark, sf, "conversations").withColumn("r", F.row_number().over(last)).where("r <= 6")
    line = F.concat(F.lit("["), F.upper("role"), F.lit("]: "), F.left("text", F.lit(300)))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("m")).select("conv_id", F.array_join("m.line", "\n").alias("context"))


@register("xor_check", "SELECT count(*) FILTER (WHERE (quality = 1) = (toxic = 1)) AS violations, count(*) AS n FROM labels")
def xor_check(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that have both or none of two fields of which exactly one must be there."""
    return table(spark, sf, "labels").agg(F.count_if((F.col("quality") == 1) == (F.col("toxic") == 1)).alias("violations"), F.count("*").alias("n"))


@register("role_rank", f"SELECT c_custkey, {RANK_SQL} >= 0 AS can_read, {RANK_SQL} >= 1 AS can_own FROM customer")
def role_rank(spark: SparkSession, sf: str) -> DataFrame:
    r = rank(role(F.col("c_mktsegment")))
    return table(spark, sf, "customer").select("c_custkey", (r >= RANKS["member"]).alias("can_read"), (r >= RANKS["owner"]).alias("can_own"))


@register("membership_gate", f"WITH m AS (SELECT c_custkey, c_nationkey, {RANK_SQL} AS r FROM customer) SELECT o.o_orderkey, CASE WHEN m.c_custkey IS NULL THEN 'not_found' WHEN m.r < 0 THEN 'forbidden' ELSE 'ok' END AS verdict FROM orders o LEFT JOIN m ON m.c_custkey = o.o_custkey AND m.c_nationkey <> 3")
def membership_gate(spark: SparkSession, sf: str) -> DataFrame:
    """No membership and too low a role are different answers."""
    members = table(spark, sf, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("o_custkey"), rank(role(F.col("c_mktsegment"))).alias("r"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(members, "o_custkey", "left")
    return rows.select("o_orderkey", F.when(F.col("r").isNull(), "not_found").when(F.col("r") < 0, "forbidden").otherwise("ok").alias("verdict"))


@register("access_cascade", f"WITH g AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN 'editor' WHEN l_returnflag = 'R' THEN 'viewer' END) AS grant_role FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) SELECT o.o_orderkey, CASE WHEN {ROLE_SQL} = 'owner' THEN 'editor' WHEN o.o_custkey = o.o_orderkey % 1500 THEN 'editor' WHEN g.grant_role IS NOT NULL THEN g.grant_role ELSE 'viewer' END AS access FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN g ON g.l_orderkey = o.o_orderkey")
def access_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Owner, else creator, else what was granted, else viewer; grants come in one join for all documents."""
    granted = F.when(F.col("l_returnflag") == "A", "editor").when(F.col("l_returnflag") == "R", "viewer")
    grants = table(spark, sf, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(granted).alias("grant_role"))
    members = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), role(F.col("c_mktsegment")).alias("role"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(members, "o_custkey").join(grants, "o_orderkey", "left")
    access = F.when(F.col("role") == "owner", "editor").when(F.col("o_custkey") == F.col("o_orderkey") % 1500, "editor").otherwise(F.coalesce("grant_role", F.lit("viewer")))
    return rows.select("o_orderkey", access.alias("access"))


@register("project_colours", f"SELECT n_nationkey, n_name, {list(X.PALETTE)}[CAST(list_sum(list_transform(string_split(n_name, ''), lambda x: ascii(x))) % {len(X.PALETTE)} AS INTEGER) + 1] AS colour FROM nation")
def project_colours(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", "n_name", X.palette_colour(F.col("n_name")).alias("colour"))


@register("retitled_citations", "SELECT l.doc_id, coalesce(d.source, concat('stored ', l.doc_id)) AS title FROM (SELECT doc_id + 500 AS doc_id FROM labels) l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def retitled_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Current titles where the paper still exists, stored ones elsewhere."""
    cited = table(spark, sf, "labels").select((F.col("doc_id") + 500).alias("doc_id"))
    current = table(spark, sf, "documents").select("doc_id", F.col("source").alias("now"))
    return cited.join(current, "doc_id", "left").select("doc_id", F.coalesce("now", F.concat(F.lit("stored "), F.col("doc_id").cast("string"))).alias("title"))


@register("path_kinds", f"WITH {TREE_SQL} SELECT page_id, regexp_extract(path, '[^/]*$', 0) AS leaf, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, starts_with(path, 'm.') AS beneath, lower(regexp_extract(regexp_extract(path, '[^/]*$', 0), '^.+\\.([^.]*)$', 1)) AS extension FROM tree")
def path_kinds(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return tree(spark, sf).select("page_id", X.basename(p).alias("leaf"), X.parent(p).alias("parent"), p.startswith("m.").alias("beneath"), X.extension(p).alias("extension"))


@register("path_validity", f"WITH {TREE_SQL}, r AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('/', path) WHEN 1 THEN concat('./', path) WHEN 2 THEN concat(path, '/../x') WHEN 3 THEN concat('C:', path) ELSE path END AS raw FROM tree), s AS (SELECT page_id, raw, list_filter(string_split(raw, '/'), lambda x: x <> '.') AS s FROM r), v AS (SELECT *, CASE WHEN starts_with(raw, '/') THEN 'absolute path' WHEN regexp_matches(raw, '^[A-Za-z]:') THEN 'drive letter' WHEN list_contains(s, '') THEN 'empty segment' WHEN list_contains(s, '..') THEN 'parent directory' WHEN len(s) > 16 THEN 'too deep' END AS reason FROM s) SELECT page_id, CASE WHEN reason IS NULL THEN array_to_string(s, '/') END AS normalized, reason FROM v")
def path_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Paths, some of them spoilt in one of three ways."""
    p, k = F.col("path"), F.col("page_id") % 5
    raw = F.when(k == 0, F.concat(F.lit("/"), p)).when(k == 1, F.concat(F.lit("./"), p)).when(k == 2, F.concat(p, F.lit("/../x"))).when(k == 3, F.concat(F.lit("C:"), p)).otherwise(p)
    return tree(spark, sf).select("page_id", X.path_verdict(raw).alias("v")).select("page_id", "v.*")


@register("path_collisions", "WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN upper(split_part(url, '/', 3)) ELSE split_part(url, '/', 3) END AS path FROM pages) SELECT lower(path) AS key, count(*) AS n, min(page_id) AS first FROM p GROUP BY lower(path) HAVING count(DISTINCT path) > 1")
def path_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that differ by case alone."""
    host = F.split_part("url", F.lit("/"), F.lit(3))
    p = table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.upper(host)).otherwise(host).alias("path"))
    return p.groupBy(F.lower("path").alias("key")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"), F.count_distinct("path").alias("d")).where("d > 1").drop("d")


@register("prefix_rename", f"WITH {TREE_SQL}, r AS (SELECT page_id, path, CASE WHEN starts_with(path, 'm.') THEN concat('mobile', substr(path, 2)) ELSE path END AS renamed FROM tree) SELECT page_id, renamed, count(*) OVER (PARTITION BY lower(renamed)) > 1 AS collides FROM r")
def prefix_rename(spark: SparkSession, sf: str) -> DataFrame:
    rows = tree(spark, sf).select("page_id", F.when(F.col("path").startswith("m."), F.concat(F.lit("mobile"), F.substr("path", F.lit(2)))).otherwise(F.col("path")).alias("renamed"))
    return rows.withColumn("collides", F.count("*").over(Window.partitionBy(F.lower("renamed"))) > 1)


@register("conflict_overlay", "WITH p AS (SELECT page_id, split_part(url, '/', 3) AS path FROM pages), o AS (SELECT p.page_id, coalesce(CASE WHEN l.quality = 0 THEN concat(p.path, ' (mine)') END, concat(p.path, ' (1)')) AS target FROM p LEFT JOIN labels l ON l.doc_id = p.page_id) SELECT page_id, target, count(*) OVER (PARTITION BY lower(target)) > 1 AS taken FROM o")
def conflict_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """A default for each conflict, overridden for some, and targets that are wanted twice."""
    p = table(spark, sf, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("path"))
    own = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("page_id"), F.lit(True).alias("own"))
    rows = p.join(own, "page_id", "left").select("page_id", F.concat("path", F.when(F.col("own"), " (mine)").otherwise(" (1)")).alias("target"))
    return rows.withColumn("taken", F.count("*").over(Window.partitionBy(F.lower("target"))) > 1)


@register("suffix_numbering", "WITH p AS (SELECT page_id, split_part(url, '/', 3) AS path FROM pages), r AS (SELECT page_id, path, row_number() OVER (PARTITION BY path ORDER BY page_id) AS r FROM p) SELECT page_id, CASE WHEN r = 1 THEN path ELSE concat(path, ' (', r - 1, ')') END AS planned FROM r")
def suffix_numbering(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers for names that come again, where no name has a number of its own yet."""
    p = table(spark, sf, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("path"))
    return running(p, "path", ["page_id"], {"r": F.lit(1)}).select("page_id", F.when(F.col("r") == 1, F.col("path")).otherwise(F.concat("path", F.lit(" ("), (F.col("r") - 1).cast("string"), F.lit(")"))).alias("planned"))


@register("project_list_counts", f"WITH n AS (SELECT c_nationkey, count(*) AS members, count(*) FILTER (WHERE {ROLE_SQL} = 'owner') AS owners FROM customer GROUP BY c_nationkey) SELECT n_nationkey, n_name, coalesce(members, 0) AS members, coalesce(owners, 0) AS owners, coalesce(owners, 0) = 1 AS last_owner FROM nation LEFT JOIN n ON n.c_nationkey = nation.n_nationkey")
def project_list_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Projects with their members and owners from one grouped join; a single owner cannot leave."""
    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("members"), F.count_if(role(F.col("c_mktsegment")) == "owner").alias("owners"))
    rows = table(spark, sf, "nation").join(counts, "n_nationkey", "left")
    none = F.lit(0).cast("long")
    return rows.select("n_nationkey", "n_name", F.coalesce("members", none).alias("members"), F.coalesce("owners", none).alias("owners"), (F.coalesce("owners", none) == 1).alias("last_owner"))


@register("member_removal", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')")
def member_removal(spark: SparkSession, sf: str) -> DataFrame:
    """Grants that remain when members are removed."""
    gone = table(spark, sf, "customer").where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(gone, "o_custkey", "left_anti").select("o_orderkey")


@register("cascade_delete", "WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)) SELECT (SELECT count(*) FROM n) AS projects, (SELECT count(*) FROM c) AS members, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)) AS runs")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """What is left when the projects of one region go, with all below them."""
    projects = table(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"))
    members = table(spark, sf, "customer").join(projects, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    runs = table(spark, sf, "orders").join(members, "o_custkey", "left_semi")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(projects, "projects").crossJoin(one(members, "members")).crossJoin(one(runs, "runs"))


@register("patched_projects", "SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN concat('new ', n_name) END, n_name) AS n_name, n_regionkey FROM nation")
def patched_projects(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "nation")
    patch = base.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("new "), "n_name")).alias("n_name"))
    return keyed.patched(base, patch, "n_nationkey")


@register("runs_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def runs_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of twenty."""
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20)


@register("runs_with_steps", "SELECT o.o_orderkey, count(l.l_linenumber) AS steps, string_agg(l.l_linenumber, ',' ORDER BY l.l_linenumber) AS step_order FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey")
def runs_with_steps(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("steps"), F.array_join(F.array_sort(F.collect_list("l_linenumber")).cast("array<string>"), ",").alias("step_order"))
    return table(spark, sf, "orders").select("o_orderkey").join(steps, "o_orderkey", "left").select("o_orderkey", F.coalesce("steps", F.lit(0).cast("long")).alias("steps"), "step_order")


@register("first_step_backfill", "SELECT o.o_orderkey, coalesce(l.l_returnflag, '') AS flag FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1")
def first_step_backfill(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return table(spark, sf, "orders").select("o_orderkey").join(first, "o_orderkey", "left").select("o_orderkey", F.coalesce("l_returnflag", F.lit("")).alias("flag"))


@register("quota_running_total", f"WITH r AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS f FROM documents) SELECT source, doc_id, CAST(b AS BIGINT) AS running_bytes, f AS running_files, b <= 60000 AND f <= {C.tree_files_cap} AS fits FROM r")
def quota_running_total(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return keyed.first_over_cap(rows, "source", ["doc_id"], "n_chars", 60_000, C.tree_files_cap).select("source", "doc_id", "running_bytes", "running_files", "fits")


@register("guarded_writes", f"WITH u AS (SELECT source, sum(n_chars) AS used FROM documents GROUP BY source) SELECT d.doc_id, CASE WHEN d.n_chars > 20000 THEN 'too large' WHEN l.doc_id IS NOT NULL AND l.quality = 0 THEN 'collision' WHEN u.used + d.n_chars > 150000 THEN 'quota' ELSE 'ok' END AS verdict FROM documents d JOIN u ON u.source = d.source LEFT JOIN labels l ON l.doc_id = d.doc_id")
def guarded_writes(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that each write breaks; a tenant's use is one sum, however many rows it has."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    used = docs.groupBy("source").agg(F.sum("n_chars").alias("used"))
    bad = table(spark, sf, "labels").where("quality = 0").select("doc_id", F.lit(True).alias("bad"))
    rows = docs.join(used, "source").join(bad, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("n_chars") > 20_000, "too large").when(F.col("bad"), "collision").when(F.col("used") + F.col("n_chars") > 150_000, "quota").otherwise("ok").alias("verdict"))


@register("selection_algebra", "WITH a AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey <= 1), v AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 2 = 0) SELECT k, 'all' AS op FROM (SELECT k FROM a UNION SELECT k FROM v) UNION ALL SELECT k, 'visible' FROM (SELECT k FROM a INTERSECT SELECT k FROM v) UNION ALL SELECT k, 'toggled' FROM ((SELECT k FROM a EXCEPT SELECT k FROM v) UNION (SELECT k FROM v EXCEPT SELECT k FROM a))")
def selection_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """Union, intersection and symmetric difference of two selections, from one grouping by key."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_regionkey") <= 1).alias("a"), (F.col("n_nationkey") % 2 == 0).alias("v"))
    both = nation.groupBy("k").agg(F.max("a").alias("a"), F.max("v").alias("v"))
    ops = F.array_compact(F.array(F.when(F.col("a") | F.col("v"), "all"), F.when(F.col("a") & F.col("v"), "visible"), F.when(F.col("a") != F.col("v"), "toggled")))
    return both.select("k", F.explode(ops).alias("op"))


@register("ordered_distinct", "WITH f AS (SELECT user_id, event_type, min(event_id) AS e FROM events GROUP BY user_id, event_type) SELECT user_id, string_agg(event_type, ',' ORDER BY e) AS types FROM f GROUP BY user_id")
def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """A user's kinds of events in order of their first appearance; grouped first, so few values a user are gathered."""
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("e"))
    return first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("e", "event_type"))).alias("m")).select("user_id", F.array_join("m.event_type", ",").alias("types"))


@register("allow_list", "SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN p_brand ELSE 'Brand#1' END AS brand FROM part")
def allow_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), F.col("p_brand")).otherwise("Brand#1").alias("brand"))


@register("byte_sizes", "SELECT doc_id, CASE WHEN n < 1024 THEN concat(n, ' B') ELSE concat(CASE WHEN r = floor(r) THEN CAST(CAST(r AS BIGINT) AS VARCHAR) ELSE printf('%.1f', r) END, ' KB') END AS shown FROM (SELECT doc_id, strlen(text) AS n, floor(strlen(text) / 1024.0::DOUBLE * 10 + 0.5) / 10 AS r FROM documents)")
def byte_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.format_bytes(F.octet_length("text")).alias("shown"))


@register("json_props", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.from_json("props", "k bigint")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@register("forwarded_client", "SELECT event_id, coalesce(nullif(trim(split_part(CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat(' ', user_id, ', 10.0.0.1') END, ',', 1)), ''), 'peer') AS client FROM events")
def forwarded_client(spark: SparkSession, sf: str) -> DataFrame:
    header = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(", 10.0.0.1")))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.nullif(F.trim(F.split_part(header, F.lit(","), F.lit(1))), F.lit("")), F.lit("peer")).alias("client"))


@register("year_tokens", "SELECT p_partkey, unnest(regexp_extract_all(concat(1900 + p_size, ' x', p_size, ' of ', 2000 + p_size), '(?:19|20)[0-9]{2}')) AS year FROM part")
def year_tokens(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    body = F.concat((1900 + size).cast("string"), F.lit(" x"), size.cast("string"), F.lit(" of "), (2000 + size).cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.explode(F.regexp_extract_all(body, F.lit("((?:19|20)[0-9]{2})"), F.lit(1))).alias("year"))
