"""Names for files that collide: one pass over the names that can meet, in order, against a growing set."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_name(path: str) -> tuple[str, str]:
    """A path up to its file's extension, and the extension; a dot file has none."""
    head, slash, leaf = path.rpartition("/")
    dot = leaf.rfind(".")
    return (f"{head}{slash}{leaf[:dot]}", leaf[dot:]) if dot > 0 else (path, "")


def free_name(path: str, taken: set[str], next_free: dict[str, int] | None = None) -> str:
    """path, or path with the first free number before its extension; case does not tell names apart.

    next_free remembers for each path where to look on, so equal names do not try
    the same numbers again.
    """
    stem, ext = split_name(path)
    key = path.lower()
    name, n = path, 0 if next_free is None else next_free.get(key, 0)
    if n:
        name = f"{stem} ({n}){ext}"
    while name.lower() in taken:
        n += 1
        name = f"{stem} ({n}){ext}"
    if next_free is not None:
        next_free[key] = n
    return name


def family(path: Column) -> Column:
    """What two names have in common if one could ever be numbered into the other: folder, stem without numbers, and extension, in lower case."""
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    return F.lower(F.concat(F.regexp_replace(stem, r"(?: \([0-9]+\))+$", ""), F.lit("/."), F.substr(path, F.char_length(stem) + 1)))


def plan_writes(rows: DataFrame, group: str, seq: str, path: str, existing: str) -> DataFrame:
    """Rows (group, seq, path, planned): rows with a true existing are there already and keep their names.

    Only names of one family can meet, so rows are dealt by group and family and
    sorted there; a pass holds the names of the family at hand.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken, next_free = object(), set(), {}
        for batch in batches:
            planned = []
            for g, f, p, old in zip(batch[group], batch["family"], batch[path], batch[existing], strict=True):
                if (g, f) != now:
                    now, taken, next_free = (g, f), set(), {}
                planned.append(p if old else free_name(p, taken, next_free))
                taken.add(planned[-1].lower())
            yield batch[[group, seq, path]].assign(planned=planned)

    chosen = rows.select(group, seq, path, F.coalesce(existing, F.lit(False)).alias(existing), family(F.col(path)).alias("family")).where(F.col(path).isNotNull() & F.col(group).isNotNull())
    dealt = chosen.repartition(group, "family").sortWithinPartitions(group, "family", F.desc(existing), seq)
    return dealt.mapInPandas(run, f"{group} {kinds[group]}, {seq} {kinds[seq]}, {path} string, planned string")
