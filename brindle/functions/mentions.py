"""Mentions of papers in a message being typed: what stands behind an @, what it becomes, and which mentions still stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: an @ further from the caret than this begins no query.
FARTHEST = 80


def mention_query(text: Column, caret: Column) -> Column:
    """Struct (query, start): what is typed behind an @ that begins a word, up to the caret; null if nothing is.

    Blanks end a query, and so does another @. Places count code points from 0.
    """
    before = F.left(text, caret)
    query = F.regexp_extract(before, rf"(?U)(?:^|\s)@([^\s@]{{0,{FARTHEST - 1}}})\z", 1)
    begun = before.rlike(rf"(?U)(?:^|\s)@[^\s@]{{0,{FARTHEST - 1}}}\z")
    return F.when(begun, F.struct(query.alias("query"), (F.least(caret, F.char_length(text)) - F.char_length(query) - 1).cast("int").alias("start")))


def mention_inserted(text: Column, start: Column, caret: Column, title: Column) -> Column:
    """Struct (text, caret): the query replaced by the whole title, with a blank behind it unless one is there."""
    after = F.substr(text, caret + 1)
    blank = F.when(after.rlike(r"(?U)\A\s"), "").otherwise(" ")
    return F.struct(F.concat(F.left(text, start), F.lit("@"), title, blank, after).alias("text"), (start + F.char_length(title) + 2).cast("int").alias("caret"))


def reconciled(text: Column, titles: Column) -> Column:
    """Places (from 0, in their order) of the mentions of a message that its text still has; a null list has none.

    The text is walked once, from one @ to the next: there stands the longest title
    that fits and has not been found yet, and the walk goes on behind it. Equal
    titles need an occurrence each; a null title never stands.
    """
    body = F.coalesce(text, F.lit(""))
    pieces = F.split(body, "@", -1)
    # code points before each @
    steps = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.char_length(p) + 1)
    marks = F.slice(F.aggregate(steps, F.array(F.lit(0)), lambda seen, n: F.array_append(seen, F.element_at(seen, -1) + n)), F.lit(2), F.size(steps))
    named = F.filter(F.transform(titles, lambda t, i: F.struct((-F.char_length(t)).alias("size"), i.alias("i"), t.alias("title"))), lambda x: x["title"].isNotNull())
    start = F.struct(F.array_sort(named).alias("left"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("free"))

    def step(seen: Column, mark: Column) -> Column:
        fits = F.get(F.filter(seen["left"], lambda x: F.substr(body, mark + 1, -x["size"]) == x["title"]), F.lit(0))

        def take(hit: Column) -> Column:
            found = F.struct(F.filter(seen["left"], lambda x: x["i"] != hit["i"]).alias("left"), F.array_append(seen["kept"], hit["i"]).alias("kept"), (mark - hit["size"]).alias("free"))
            return F.when((mark <= seen["free"]) | hit.isNull(), seen).otherwise(found)

        return F.get(F.transform(F.array(fits), take), F.lit(0))

    walked = F.aggregate(marks, start, step, lambda seen: F.array_sort(seen["kept"]))
    return F.when(titles.isNull(), F.array().cast("array<int>")).otherwise(walked)
