"""Text rules as columns; what needs Unicode tables is in functions/folding.py."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.bindings import words

#: Publishers whose names end a page's title.
PUBLISHERS = r"ScienceDirect|Elsevier|IEEE\s*Xplore|ACM\s*Digital\s*Library|Springer(?:Link)?|Nature|Wiley|Taylor\s*&\s*Francis|MDPI|PubMed|arXiv|ResearchGate|Semantic\s*Scholar"
#: Colours of projects that were never given one.
PALETTE = ("#3B82F6", "#8B5CF6", "#EC4899", "#EF4444", "#F97316", "#EAB308", "#22C55E", "#14B8A6", "#06B6D4", "#64748B")
#: Beginnings of words that ask for authors, year or venue.
METADATA_WORDS = ("author", "wrote", "written", "who", "year", "when", "dat", "publish", "publication", "venue", "journal", "conference", "proceeding", "cit", "newest", "latest", "oldest", "recent", "earliest")
METADATA = rf"(?i)(?:^|[^a-z0-9_])(?:{'|'.join(METADATA_WORDS)})|(?:^|[^a-z0-9_])(?:19|20)[0-9]{{2}}(?:$|[^a-z0-9_])"
#: Fixed value: what a caption looks like.
CAPTION = r"(?i)((?:Figure|Fig\.?)\s+\d+[.:—-]?\s+\S[^\n]{4,300})"
#: What a DOI looks like, and where arXiv keeps its PDFs.
DOI = r"10\.\d{4,}/[^\s\"<>]+"
ARXIV_PDF = r"^(https?://arxiv\.org)/pdf/"
TITLE_CHARS, ABSTRACT_CHARS, PAGE_CHARS = 300, 4000, 200_000
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of a text in lower case, in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def canonical_url(url: Column) -> Column:
    """Without scheme, leading www. and trailing slashes, in lower case."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[^:]*://|^.*?://", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"/+$", "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unescaped(text: Column) -> Column:
    """The five named entities of markup; & last."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def head_of_page(html: Column) -> Column:
    """What is read of a page: up to the end of its head, and not beyond PAGE_CHARS."""
    return F.left(F.substring_index(html, "</head>", 1), F.lit(PAGE_CHARS))


def meta_content(html: Column, attribute: str, value: str) -> Column:
    """Content of a meta tag, whatever the order of its attributes and their quotes; null if absent."""
    named = rf"\b{attribute}=[\"']?{value}[\"']?"
    content = r"\bcontent=[\"']([^\"'<>]+)[\"']"
    first = F.regexp_extract(html, rf"(?i)<meta\b[^>]+{named}[^>]+{content}", 1)
    second = F.regexp_extract(html, rf"(?i)<meta\b[^>]+{content}[^>]+{named}", 1)
    found = F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))
    return unescaped(F.trim(found))


def html_title(html: Column) -> Column:
    """citation_title, else og:title, else the title tag without its publisher; null if none says anything."""
    tag = F.trim(F.regexp_replace(unescaped(F.trim(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1))), rf"(?i)\s*[|–-]\s*(?:{PUBLISHERS}).*$", ""))
    found = F.coalesce(meta_content(html, "name", "citation_title"), meta_content(html, "property", "og:title"), F.nullif(tag, F.lit("")))
    return F.left(found, F.lit(TITLE_CHARS))


def html_abstract(html: Column) -> Column:
    found = F.coalesce(meta_content(html, "name", "citation_abstract"), meta_content(html, "property", "og:description"), meta_content(html, "name", "description"))
    return F.left(found, F.lit(ABSTRACT_CHARS))


def doi(text: Column) -> Column:
    """The first DOI: its prefix of four digits or more, and what follows the slash up to a blank, a double quote or an angle bracket."""
    return F.nullif(F.regexp_extract(text, DOI, 0), F.lit(""))


def abstract_page(url: Column) -> Column:
    """An arXiv PDF's address as that of its abstract page, whatever is behind the paper's number; any other as it is."""
    paper = F.regexp_replace(F.regexp_replace(url, f"(?i){ARXIV_PDF}", ""), r"(?i)(?<=.)\.pdf$", "")
    site = F.regexp_extract(url, f"(?i){ARXIV_PDF}", 1)
    return F.when((site != "") & (paper != ""), F.concat(site, F.lit("/abs/"), paper)).otherwise(url)


def captions(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(CAPTION), F.lit(1)), lambda x: F.trim(x))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of overlapping runs of words; the last one ends with the text, so no tail is repeated."""
    found = words(text)
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size(found) - size) / step)).cast("int")
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(found, i * step + 1, size), " "))
    return F.when(F.size(found) > 0, each).otherwise(F.array().cast("array<string>"))


def palette_colour(seed: Column) -> Column:
    """The colour at the sum of the seed's bytes, counted round the palette."""
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(seed)), lambda i: F.conv(F.substr(F.hex(F.encode(seed, "UTF-8")), 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    total = F.when(F.octet_length(seed) > 0, F.aggregate(bytes_, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(0)
    return F.element_at(F.array(*map(F.lit, PALETTE)), (total % len(PALETTE)).cast("int") + 1)


def matches_search(query: Column, *fields: Column) -> Column:
    """Whether each word of a query is somewhere in the fields; an empty query fits all."""
    hay = F.lower(F.concat_ws("\n", *[F.nullif(f, F.lit("")) for f in fields]))
    return F.forall(F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda t: t != ""), lambda t: F.contains(hay, t))


def metadata_intent(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(METADATA)


def format_bytes(n: Column) -> Column:
    """B, KB, MB or GB with at most one decimal; rounded before the unit is chosen."""
    units = ("KB", "MB", "GB")
    shown = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.format_string("%.1f", x))
    rounded = [F.floor(n / F.lit(1024.0 ** (i + 1)) * 10 + 0.5) / 10 for i in range(3)]
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(units):
        text = F.concat(shown(rounded[i]), F.lit(f" {unit}"))
        out = out.when(rounded[i] < 1024, text) if i < 2 else out.otherwise(text)
    return out


def relative_time(then: Column, now: Column) -> Column:
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 86_400_000_000)
    months = F.floor(days / 30)
    years = F.floor(months / 12)
    many = lambda n, unit: F.when(n == 1, F.lit(f"1 {unit} ago")).otherwise(F.concat(n.cast("string"), F.lit(f" {unit}s ago")))
    return F.when(days == 0, "Today").when(days < 30, many(days, "day")).when(months < 12, many(months, "month")).otherwise(many(years, "year"))


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """In lower case, without the dot; empty for none or for a dot file."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def path_verdict(raw: Column) -> Column:
    """Struct (normalized, reason): one of both is null."""
    segments = F.split(raw, "/", -1)
    stay = F.filter(segments, lambda x: x != ".")
    joined = F.array_join(stay, "/")
    reason = (
        F.when(F.coalesce(F.trim(F.regexp_replace(raw, r"\s", " ")), F.lit("")) == "", "empty path")
        .when(raw.rlike(r"[\x00-\x1f\x7f]"), "control characters")
        .when(F.contains(raw, F.lit("\\")), "backslash")
        .when(raw.startswith("/"), "absolute path")
        .when(raw.rlike("^[A-Za-z]:"), "drive letter")
        .when(F.array_contains(stay, ""), "empty segment")
        .when(F.array_contains(stay, ".."), "parent directory")
        .when(F.exists(stay, lambda x: F.char_length(x) > 200), "segment too long")
        .when(F.size(stay) == 0, "empty path")
        .when(F.size(stay) > 16, "too deep")
        .when(F.char_length(joined) > 400, "path too long")
    )
    return F.struct(F.when(reason.isNull(), joined).alias("normalized"), reason.alias("reason"))


def highlighted(text: Column, terms: Column, mark: str = "mark") -> Column:
    """text with every term in a tag, case aside; of terms that begin at one place the longest is marked. No terms mark nothing."""
    longest = F.transform(F.array_sort(F.transform(F.array_distinct(F.filter(terms, lambda t: t.isNotNull() & (t != ""))), lambda t: F.struct((-F.char_length(t)).alias("n"), t.alias("t")))), lambda x: F.regexp_replace(x["t"], r"([\\^$.|?*+()\[\]{}])", r"\\$1"))
    return F.when(F.size(longest) > 0, F.regexp_replace(text, F.concat(F.lit("(?i)("), F.array_join(longest, "|"), F.lit(")")), F.lit(f"<{mark}>$1</{mark}>"))).otherwise(text)


def filename(title: Column) -> Column:
    cleaned = F.regexp_replace(F.left(squeezed(F.regexp_replace(title, r'[\\/:*?"<>|]', "-")), F.lit(80)), r"[. ]+$", "")
    return F.concat(F.when(cleaned.rlike(r"[\p{L}\p{N}]"), cleaned).otherwise("conversation"), F.lit(".md"))
