"""English stems of a table of words, by the rules of the Snowball project's English stemmer (Porter's second).

Words are stemmed where they are few: once each in a vocabulary, never in texts. Each
step is one projection whose rules are data; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words with a stem of their own, words that stay, words that stay after the plural is gone, beginnings whose region starts behind them.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
KEPT_LATER = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
BEGINNINGS = ("gener", "commun", "arsen")
# Endings and what they become in the first region; "l" and "li" mark endings with a condition on the letter before.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
LI_BEFORE = "cdeghkmnrt"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
VOWELS = "aeiouy"

#: A syllable that counts as short: at a word's end, or all of a word.
_SHORT = rf"(?:[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]|^[{VOWELS}][^{VOWELS}])\z"


def _less(w: Column, ending: str, put: str = "") -> Column:
    rest = F.left(w, F.length(w) - len(ending))
    return F.concat(rest, F.lit(put)) if put else rest


def _first(w: Column, rules: list[tuple[str, Column]]) -> Column:
    """The result of the longest ending that w has, w itself without any."""
    found = None
    for ending, result in sorted(rules, key=lambda rule: -len(rule[0])):
        found = F.when(w.endswith(ending), result) if found is None else found.when(w.endswith(ending), result)
    return found.otherwise(w)


def stemmed(words: DataFrame, word: str = "term", stem: str = "stem") -> DataFrame:
    """words with a column stem; a word of one or two letters is its own stem, as is one in another script, and null stays null."""
    w, region1, region2 = F.col("__w"), F.col("__1"), F.col("__2")
    within = lambda ending, region: F.length(w) - len(ending) >= region
    has_vowel = lambda c: c.rlike(f"[{VOWELS}]")
    opened = rf"^.*?[{VOWELS}][^{VOWELS}]"
    span = lambda c: F.coalesce(F.nullif(F.length(F.regexp_extract(c, rf"({opened})", 1)), F.lit(0)), F.length(c))

    rows = words.withColumn("__w", F.regexp_replace(F.regexp_replace(F.col(word), "^y", "Y"), f"([{VOWELS}])y", "$1Y"))
    begun = F.regexp_extract("__w", f"^(?:{'|'.join(BEGINNINGS)})", 0)
    rows = rows.withColumn("__1", F.when(begun != "", F.length(begun)).otherwise(span(w)))
    rows = rows.withColumn("__2", region1 + span(F.substr(w, region1 + 1)))

    def step(value: Column) -> None:
        nonlocal rows
        rows = rows.withColumn("__w", value)

    # plurals
    ies = F.when(F.length(w) > 4, _less(w, "ies", "i")).otherwise(_less(w, "ies", "ie"))
    step(_first(w, [("sses", _less(w, "es")), ("ied", ies), ("ies", ies), ("us", w), ("ss", w), ("s", F.when(has_vowel(F.left(w, F.length(w) - 2)), _less(w, "s")).otherwise(w))]))
    rows = rows.withColumn("__stays", w.isin(*KEPT_LATER))
    # past forms and gerunds: what is left may have lost an e or doubled a letter
    gone = lambda ending: F.when(has_vowel(_less(w, ending)), F.concat(_less(w, ending), F.lit("|"))).otherwise(w)
    eed = lambda ending: F.when(within(ending, region1), _less(w, ending, "ee")).otherwise(w)
    step(_first(w, [("eed", eed("eed")), ("eedly", eed("eedly")), *[(e, gone(e)) for e in ("ed", "edly", "ing", "ingly")]]))
    bare = F.rtrim(w, F.lit("|"))
    short = (F.length(bare) <= region1) & bare.rlike(_SHORT)
    mended = F.when(bare.rlike(r"(?:at|bl|iz)\z"), F.concat(bare, F.lit("e"))).when(bare.rlike(rf"(?:{'|'.join(DOUBLES)})\z"), F.left(bare, F.length(bare) - 1)).when(short, F.concat(bare, F.lit("e"))).otherwise(bare)
    step(F.when(w.endswith("|"), mended).otherwise(w))
    step(F.when(w.rlike(rf"^.+[^{VOWELS}][yY]\z"), _less(w, "y", "i")).otherwise(w))
    before = {"ogi": w.endswith("logi"), "li": w.rlike(rf"[{LI_BEFORE}]li\z")}
    step(_first(w, [(e, F.when(within(e, region1) & before.get(e, F.lit(True)), _less(w, e, put)).otherwise(w)) for e, put in SECOND.items()]))
    step(_first(w, [(e, F.when(within(e, region2 if e == "ative" else region1), _less(w, e, put)).otherwise(w)) for e, put in THIRD.items()]))
    step(_first(w, [(e, F.when(within(e, region2) & (w.rlike(r"[st]ion\z") if e == "ion" else F.lit(True)), _less(w, e)).otherwise(w)) for e in FOURTH]))
    e_goes = within("e", region2) | (within("e", region1) & ~_less(w, "e").rlike(_SHORT))
    step(F.when(w.endswith("e") & e_goes, _less(w, "e")).when(w.endswith("ll") & within("l", region2), _less(w, "l")).otherwise(w))
    done = F.replace(w, F.lit("Y"), F.lit("y"))
    special = F.coalesce(*[F.when(F.col(word) == k, F.lit(v)) for k, v in IRREGULAR.items()])
    plain = F.when(F.col("__stays"), F.col("__plural")).otherwise(done)
    found = F.when((F.length(word) <= 2) | F.col(word).isin(*KEPT), F.col(word)).otherwise(F.coalesce(special, plain))
    # a word that stays after its plural is gone is one of the words as they are written there
    rows = rows.withColumn("__plural", F.when(F.col(word).endswith("s"), _less(F.col(word), "s")).otherwise(F.col(word)))
    return rows.withColumn(stem, found).drop("__w", "__1", "__2", "__stays", "__plural")
