"""Porter's algorithm (1980) with the two departures of its author's own later programs: of one word, and as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The suffix tables of the published algorithm.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant. Upper case is neither vowel nor suffix."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    s = _shape(w)
    return sum(a == "v" and b == "c" for a, b in zip(s, s[1:], strict=False))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, table, least: int) -> str:
    """The longest suffix of the table decides; it is replaced if what is left has more than `least` measures."""
    for end, new in sorted(table, key=lambda x: -len(x[0])):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + new if _measure(stem) > least else w
    return w


def porter(w: str) -> str:
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]):
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2, 0), STEP3, 0)
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w[-1] == "l":
        w = w[:-1]
    return w


def stem(token: str) -> str:
    """Tokens of up to three characters stay, and so does a token whose stem would have fewer than three."""
    if len(token) <= 3:
        return token
    s = porter(token)
    return s if len(s) >= 3 else token


def _letters(w: Column) -> Column:
    """`_shape` as a column: a y is told by the letter before it, and only words with several in a row are walked through."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "[^aeiouy]", "c"), "[aeiou]", "v"), "^y", "c")
    single = F.replace(F.replace(plain, F.lit("cy"), F.lit("cv")), F.lit("vy"), F.lit("vc"))
    walked = F.aggregate(F.split(w, ""), F.lit(""), lambda a, x: F.concat(a, F.when(x.isin(*"aeiou") | ((x == "y") & F.endswith(a, F.lit("c"))), "v").otherwise("c")))
    return F.when(F.contains(w, F.lit("yy")), walked).otherwise(single)


def _without(n: int, column: str = "_w") -> Column:
    return F.left(F.col(column), F.length(column) - n)


def _measured(cut: int) -> Column:
    """The measure of the word without its last letters."""
    x = _without(cut, "_s")
    return F.length(x) - F.length(F.replace(x, F.lit("vc")))


def _ends(*suffixes: str) -> Column:
    return reduce(lambda a, b: a | b, (F.endswith("_w", F.lit(x)) for x in suffixes))


def _ends_short(cut: int) -> Column:
    """`_cvc` of the word without its last letters."""
    return F.endswith(_without(cut, "_s"), F.lit("cvc")) & ~F.right(_without(cut), F.lit(1)).isin("w", "x", "y")


def _change(cut: int, new: str = "") -> Column:
    """So many letters off the end, one digit, and the letters that come in their place, of which none is a y."""
    return F.lit(f"{cut}{new}")


def _changed(column: str, new: Column) -> Column:
    cut = F.left("_k", F.lit(1)).cast("int")
    return F.when(F.col("_k").isNull(), F.col(column)).otherwise(F.concat(F.left(F.col(column), F.length(column) - cut), new))


def _swapped(table, least: int, more: Column | None = None) -> Column:
    """The longest suffix of the table decides, as in `_swap`; `more` is asked of the suffix ion. A measure is two letters."""
    out = None
    for end, new in sorted(table, key=lambda x: -len(x[0])):
        hit = _measured(len(end)) > 2 * least
        new = F.when(hit & more if end == "ion" and more is not None else hit, _change(len(end), new))
        out = F.when(_ends(end), new) if out is None else out.when(_ends(end), new)
    return out


def _steps() -> list[dict[str, Column]]:
    """The algorithm's steps; each is given the word `_w` and its letters `_s`, and says what changes, if anything does."""
    w = F.col("_w")
    double = F.endswith("_s", F.lit("c")) & (F.right(w, F.lit(1)) == F.right(_without(1), F.lit(1)))
    cut = {e: _ends(e) & F.contains(_without(len(e), "_s"), F.lit("v")) for e in ("ed", "ing")}
    return [
        {"_k": F.when(_ends("sses", "ies"), _change(2)).when(_ends("s") & ~_ends("ss"), _change(1))},
        {"_k": F.when(_ends("eed"), F.when(_measured(3) > 0, _change(1))).when(cut["ed"], _change(2)).when(cut["ing"], _change(3)), "_cut": ~_ends("eed") & (cut["ed"] | cut["ing"])},
        {"_k": F.when(F.col("_cut"), F.when(_ends("at", "bl", "iz"), _change(0, "e")).when(double & ~_ends("l", "s", "z"), _change(1)).when((_measured(0) == 2) & _ends_short(0), _change(0, "e")))},
        {"_k": F.when(_ends("y") & F.contains(_without(1, "_s"), F.lit("v")), _change(1, "i"))},
        {"_k": _swapped(STEP2, 0)},
        {"_k": _swapped(STEP3, 0)},
        {"_k": _swapped([(e, "") for e in STEP4], 1, F.right(_without(3), F.lit(1)).isin("s", "t"))},
        {"_k": F.when(_ends("e") & ((_measured(1) > 2) | ((_measured(1) == 2) & ~_ends_short(1))), _change(1))},
        {"_k": F.when((_measured(0) > 2) & double & _ends("l"), _change(1))},
    ]


#: The letters that a word must end with for any step to change it.
LAST = sorted({e[-1] for e, _ in STEP2 + STEP3} | {e[-1] for e in STEP4} | set("sdgyel"))


def stemmed(rows: DataFrame, token: str, out: str) -> DataFrame:
    """rows with the stem of `token` as `out`; null tokens have null stems.

    The steps are column expressions, so each distinct token is stemmed once and the dictionary of those that may change
    is joined back, as a broadcast where it is small. A word's letters are told apart once: what is left of it after a
    step has the letters that it had.
    """
    may = (F.length("_t") > 3) & F.right("_t", F.lit(1)).isin(LAST)
    found = rows.select(F.col(token).alias("_t")).where(may).distinct().select("_t", F.col("_t").alias("_w"), F.lit(False).alias("_cut"))
    found = found.withColumn("_s", _letters(F.col("_w")))
    new, letters = F.substring("_k", 2, 9), "abcdefghijklmnopqrstuvwxz"
    for step in _steps():
        found = found.withColumns(step).withColumns({"_w": _changed("_w", new), "_s": _changed("_s", F.translate(new, letters, _shape(letters)))})
    # no filter on the stem: Spark would push it below the steps, each of them spelt out in the next
    dictionary = found.select("_t", F.when(F.length("_w") >= 3, F.col("_w")).otherwise(F.col("_t")).alias("_stem_of"))
    joined = rows.join(dictionary, rows[token] == dictionary["_t"], "left")
    return joined.withColumn(out, F.coalesce("_stem_of", F.col(token))).drop("_t", "_stem_of")
