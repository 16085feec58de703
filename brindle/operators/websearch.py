"""Questions as people type them: words, "quoted phrases", or between alternatives, a minus before what must be absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.stemming import stemmed
from brindle.functions.text import tokens
from brindle.operators import packs
from brindle.operators.lexical import placed, ranked
from brindle.operators.postings import Index, variants
from brindle.store import written

#: Words that English full-text search leaves out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
#: A phrase in quotes (the last one may be left open) or a run without blanks and quotes, perhaps behind a minus.
PIECE = r'-?"[^"]*"?|[^\s"]+'


def asked_for(questions: DataFrame, index: Index | None = None) -> DataFrame:
    """Rows (question_id, part, asked, no, atom, need, place, term): what each alternative of a question asks for or refuses.

    questions: question_id, text. What is quoted, or holds several words without
    a blank, is a phrase: its words stand as far apart as they are typed. Stop
    words only keep their place. asked counts the different atoms that a part
    needs; a question of stop words alone has no rows, as has a null one. With an
    index, words are taken for their stems: atoms are told apart by them, and a
    place has a row for each token of the corpus that has its stem (one row, with
    the stem, if none has).
    """
    pieces = questions.select("question_id", F.posexplode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).alias("at", "piece"))
    parts = pieces.withColumn("part", F.count_if(F.lower("piece") == "or").over(Window.partitionBy("question_id").orderBy("at")))
    words = parts.select("question_id", "part", "at", F.col("piece").startswith("-").alias("no"), F.posexplode(tokens(F.col("piece"))).alias("place", "term")).where(~F.col("term").isin(STOP_WORDS))
    if index is not None:
        words = stemmed(words).drop("term").withColumnRenamed("stem", "term")
    said = words.groupBy("question_id", "part", "at", "no").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("terms"))
    begin = F.transform("terms", lambda x: F.struct((x["place"] - F.col("terms")[0]["place"]).alias("place"), x["term"].alias("term")))
    atoms = said.select("question_id", "part", "no", begin.alias("terms")).withColumn("atom", F.array_join(F.transform("terms", lambda x: F.concat_ws(":", x["place"].cast("string"), x["term"])), " "))
    once = atoms.dropDuplicates(["question_id", "part", "no", "atom"])
    counted = once.withColumn("asked", F.count_if(~F.col("no")).over(Window.partitionBy("question_id", "part")))
    rows = counted.select("question_id", "part", "asked", "no", "atom", F.size("terms").alias("need"), F.inline("terms"))
    if index is None:
        return rows
    told = written(rows.withColumnRenamed("term", "stem"), "asked-stems")
    return told.join(variants(index, told), "stem", "left").select(*rows.columns[:-1], F.coalesce("term", "stem").alias("term"), "stem")


def search(chunks: DataFrame | Index, questions: DataFrame, stems: bool = False) -> DataFrame:
    """Rows (question_id, id, paper_id, tf): chunks that hold everything some alternative asks for and nothing it refuses.

    chunks: id, paper_id, text, or their index, which stems need: then a word finds
    every token with its stem. tf counts the finds of the alternative that has
    most. An alternative of refusals alone finds nothing, for nothing would rank
    its finds. Only tokens that some question names leave the scan, and single
    words are counted before they are shuffled.
    """
    if stems and not isinstance(chunks, Index):
        raise ValueError("stems are kept in an index")
    asked = asked_for(questions, chunks if stems else None)
    hits = placed(chunks, asked).withColumn("start", F.when(F.col("need") > 1, F.col("at") - F.col("place")))
    whole = ["question_id", "part", "asked", "id", "paper_id"]
    runs = hits.groupBy(*whole, "no", "atom", "need", "start").agg(F.count("*").alias("n")).where((F.col("need") == 1) | (F.col("n") == F.col("need")))
    found = runs.groupBy(*whole, "no", "atom").agg(F.sum(F.when(F.col("need") == 1, F.col("n")).otherwise(1)).alias("tf"))
    parts = found.groupBy(*whole).agg(F.sum(F.when(~F.col("no"), F.col("tf"))).alias("tf"), F.count_if(~F.col("no")).alias("n"), F.max("no").alias("refused"))
    return parts.where(~F.col("refused") & (F.col("n") == F.col("asked"))).groupBy("question_id", "id", "paper_id").agg(F.max("tf").alias("tf"))


def best(chunks: DataFrame | Index, questions: DataFrame, pool: int, stems: bool = False, scope: DataFrame | None = None) -> DataFrame:
    """The pool best of search(), with s_rank; scope (question_id, paper_id) names the papers that a question may find.

    With an index, pairs of question and chunk stay in the tasks (see packs).
    """
    if not isinstance(chunks, Index):
        found = search(chunks, questions, stems)
        return ranked(found if scope is None else found.join(scope, ["question_id", "paper_id"], "left_semi"), pool)
    rows = asked_for(questions, chunks if stems else None)
    asked = rows.select("question_id", "part", "no", "atom", "place", "term", F.col("stem" if stems else "term").alias("unit"))
    found = packs.best(chunks, asked, pool, scope=scope)
    return ranked(found.select("question_id", "id", "paper_id", F.col("score").cast("long").alias("tf")), pool)
