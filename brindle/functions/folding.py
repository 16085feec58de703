"""Unicode folding, which Spark has no column functions for: small helpers that run on Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters whose stroke is no combining mark.
STROKES = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ı": "i", "æ": "ae", "œ": "oe"})
#: Stray accents and the marks they stand for; the first go with the letter behind them, the last two with the one before.
ABOVE = {"¨": "\u0308", "´": "\u0301", "¯": "\u0304", "ˆ": "\u0302", "ˇ": "\u030c", "˘": "\u0306", "˙": "\u0307", "˚": "\u030a", "˜": "\u0303", "˝": "\u030b"}
BELOW = {"¸": "\u0327", "˛": "\u0328"}
_BELOW = re.compile(rf"([^\W\d_][{''.join(ABOVE.values())}]*)([{''.join(BELOW)}])")
_ABOVE = re.compile(rf"([{''.join(ABOVE)}])([^\W\d_])")


def fold(text: str | None) -> str:
    """Lower-case ASCII words with single spaces; applying it again changes nothing."""
    flat = unicodedata.normalize("NFKD", (text or "").casefold().translate(STROKES))
    return " ".join(re.findall(r"[0-9a-z]+", "".join(c for c in flat if not unicodedata.combining(c))))


def recompose(text: str | None) -> str | None:
    """Accents that stand beside their letter are put on it; no other character is lost."""
    if not text:
        return text
    text = _BELOW.sub(lambda m: unicodedata.normalize("NFC", m[1] + BELOW[m[2]]), text)
    return unicodedata.normalize("NFC", _ABOVE.sub(lambda m: unicodedata.normalize("NFC", m[2] + ABOVE[m[1]]), text))


def metadata_key(text: str | None) -> str | None:
    """Key of a stated name: without marks and stray accents, spaces squeezed, case folded; null if nothing is left."""
    flat = unicodedata.normalize("NFKD", "".join(c for c in text or "" if unicodedata.category(c) != "Sk"))
    return " ".join("".join(c for c in flat if unicodedata.category(c) != "Mn").split()).casefold() or None




@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    return texts.map(fold)


@F.pandas_udf(T.StringType())
def recomposed(texts: pd.Series) -> pd.Series:
    return texts.map(recompose)


@F.pandas_udf(T.StringType())
def metadata_keyed(texts: pd.Series) -> pd.Series:
    return texts.map(metadata_key)
