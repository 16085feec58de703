"""Citation markers of one answer: one scan tells code, headings and markers apart, and every pass works on its tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a title that a heading must quote in one run.
TITLE_RUN = 4
GONE = "[source unavailable]"
#: What opens a block of code, and closes it.
FENCES = ("```", "~~~")


class Token(NamedTuple):
    """kind: code, head (a list item's or heading's line) or mark (one or several numbers in brackets)."""

    kind: str
    start: int
    end: int
    numbers: tuple[int, ...] = ()


def _fenced(text: str) -> Iterator[tuple[int, int]]:
    """Blocks of code; one that is never closed runs to the end."""
    at = 0
    while opened := [p for p in (text.find(f, at) for f in FENCES) if p >= 0]:
        start = min(opened)
        close = text.find(text[start : start + 3], start + 3)
        at = len(text) if close < 0 else close + 3
        yield start, at


def _quoted(text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Code between two backticks of one line."""
    while (start := text.find("`", at, end)) >= 0 and (close := text.find("`", start + 1, end)) >= 0:
        if "\n" in text[start:close]:
            at = close
        else:
            at = close + 1
            yield start, at


def code_spans(text: str) -> list[tuple[int, int]]:
    """Where code stands: blocks first, then what is quoted in the prose between them."""
    out, at = [], 0
    for start, end in [*_fenced(text), (len(text), len(text))]:
        out += [*_quoted(text, at, start), (start, end)]
        at = end
    return out[:-1]


def _numbers(inner: str) -> tuple[int, ...]:
    """The numbers of a marker: digits, or several with commas between; none for anything else."""
    parts = [part.strip() for part in inner.split(",")]
    return tuple(map(int, parts)) if inner == inner.strip() and all(part.isdecimal() for part in parts) else ()


def _marks(text: str, at: int, end: int) -> Iterator[Token]:
    while (start := text.find("[", at, end)) >= 0:
        close = text.find("]", start, end)
        if close < 0:
            return
        numbers = _numbers(text[start + 1 : close])
        if numbers:
            yield Token("mark", start, close + 1, numbers)
        at = close + 1 if numbers else start + 1


def is_heading(line: str) -> bool:
    """Whether a line is a heading, or an item of a list."""
    body = line.lstrip(" \t")
    mark = body.rstrip("\n").partition(" ")[0].partition("\t")[0]
    return body.startswith("#") or (mark in ("-", "*", "+") or mark.endswith(".") and mark[:-1].isdecimal()) and body[len(mark) : len(mark) + 1] in (" ", "\t")


def scan(text: str) -> list[Token]:
    """All tokens in order; what stands between them is prose."""
    code = code_spans(text)
    tokens = [Token("code", *span) for span in code]
    prose, at = [], 0
    for start, end in [*code, (len(text), len(text))]:
        prose.append((at, start))
        at = end
    tokens += [mark for span in prose for mark in _marks(text, *span)]
    at = 0
    for line in text.splitlines(keepends=True):
        if is_heading(line) and not any(start <= at < end for start, end in code):
            tokens.append(Token("head", at, at + len(line)))
        at += len(line)
    return sorted(tokens, key=lambda t: (t.start, t.kind != "head"))


def _rewritten(text: str, changes: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, new in changes:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def expand(text: str, most: int) -> str:
    """[8, 14] to [8], [14], if all numbers are of the catalog."""
    groups = [t for t in scan(text) if len(t.numbers) > 1 and all(0 < n <= most for n in t.numbers)]
    return _rewritten(text, [(t.start, t.end, ", ".join(f"[{n}]" for n in t.numbers)) for t in groups])


def common_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of words that both have."""
    at: dict[str, list[int]] = {}
    for j, word in enumerate(b):
        at.setdefault(word, []).append(j)
    best, ends = 0, {}
    for word in a:
        ends = {j: ends.get(j - 1, 0) + 1 for j in at.get(word, ())}
        best = max(best, *ends.values(), 0)
    return best


def _words(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def named_paper(line: str, titles: dict[str, list[str]]) -> str | None:
    """The paper whose title, of those given by their words, a line quotes with the longest run of all; none on a tie."""
    runs = {paper: common_run(title, _words(line)) for paper, title in titles.items()}
    best = max(runs.values(), default=0)
    owners = [paper for paper, n in runs.items() if n == best]
    return owners[0] if best >= TITLE_RUN and len(owners) == 1 else None


def _runs(text: str, tokens: list[Token]) -> list[list[Token]]:
    """Single markers with nothing between them but blanks and at most one comma or semicolon."""
    out: list[list[Token]] = []
    for token in tokens:
        if token.kind == "mark" and len(token.numbers) == 1:
            beside = out and out[-1][-1].end <= token.start
            between = text[out[-1][-1].end : token.start].replace("\t", "").replace(" ", "") if beside else "none"
            if between in ("", ",", ";"):
                out[-1].append(token)
            else:
                out.append([token])
    return out


def strip(text: str, papers: dict[int, str], titles: dict[str, str]) -> tuple[str, list[int]]:
    """Markers of another paper than the one a heading names are taken out of what stands below it; numbers that no chunk has stay."""
    known = {paper: words for paper, title in titles.items() if len(words := _words(title)) >= TITLE_RUN}
    tokens = scan(text)
    heads = [(t.start, named_paper(text[t.start : t.end], known)) for t in tokens if t.kind == "head"]
    changes, dropped = [], []
    for run in _runs(text, tokens):
        owner = next((paper for start, paper in reversed(heads) if start <= run[0].start), None)
        stay = [t for t in run if owner is None or papers.get(t.numbers[0], owner) == owner]
        if len(stay) < len(run):
            dropped += [t.numbers[0] for t in run if t not in stay]
            inside = text[run[0].start : run[-1].end]
            mark = next((c for c in ",;" if c in inside), "")
            # with nothing left, the blanks in front go too
            start = run[0].start if stay else len(text[: run[0].start].rstrip(" \t"))
            changes.append((start, run[-1].end, f"{mark} ".join(text[t.start : t.end] for t in stay)))
    return _rewritten(text, changes), dropped


def renumber(text: str, most: int) -> tuple[str, dict[int, int]]:
    """Numbers from 1 in order of appearance in prose; a number that the catalog does not have is said to be gone."""
    new: dict[int, int] = {}
    marks = [t for t in scan(text) if len(t.numbers) == 1]
    shown = [f"[{new.setdefault(t.numbers[0], len(new) + 1)}]" if 0 < t.numbers[0] <= most else GONE for t in marks]
    return _rewritten(text, [(t.start, t.end, s) for t, s in zip(marks, shown, strict=True)]), new


def tokenise(text: str, valid: set[int]) -> list[tuple[str, str, list[int]]]:
    """(kind, value, run) pieces: prose, and markers with the run of markers they stand in."""
    marks = [t for t in _marks(text, 0, len(text)) if len(t.numbers) == 1 and t.numbers[0] in valid]
    runs: list[list[Token]] = []
    for mark in marks:
        beside = bool(runs) and not re.sub(r"\s|,|;|and|or", "", text[runs[-1][-1].end : mark.start])
        runs[-1].append(mark) if beside else runs.append([mark])
    out, at = [], 0
    for run in runs:
        for mark in run:
            if mark.start > at:
                out.append(("text", text[at : mark.start], []))
            out.append(("cite", text[mark.start + 1 : mark.end - 1], [t.numbers[0] for t in run]))
            at = mark.end
    return out + [("text", text[at:], [])] if at < len(text) or not out else out


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("stripped", T.ArrayType(T.IntegerType())), T.StructField("old", T.ArrayType(T.IntegerType()))]))
def cited(texts: pd.Series, most: pd.Series, papers: pd.Series, titles: pd.Series) -> pd.DataFrame:
    """An answer's markers expanded, stripped and renumbered, in this order; old: the numbers behind 1, 2, ...; papers: of each number, from 1."""
    out = []
    for text, n, owners, named in zip(texts, most, papers, titles, strict=True):
        plain, dropped = strip(expand(text or "", int(n)), dict(enumerate(owners, 1)), dict(named or {}))
        plain, new = renumber(plain, int(n))
        out.append((plain, dropped, list(new)))
    return pd.DataFrame(out, columns=["text", "stripped", "old"])
