"""Tokenisers, stop words and the term pipeline, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.stems import stemmed

# The characters that end a token, by field. Results depend on each of them.
TITLE = (
    " .:,[]-―−—–‑‐‒─⎯⁻\"?“”◆!{}()+<>›'‹_″‟„¶|\\¿;»«§¡¸±：×^＂*@・˚•·∼°⁺◦，⋅ªº␣\ufffd≥⋯≡／∕"
    "∣ⓡ£€ⅰ⁃╉＜＞（）【】《》〈〉〔〕≪≫「」╅│｜－？＋✔✓←↑→↓↔⇑⇒⇔⇤①②③④⑤⑥⑦⑧⑨⑩…‡†‗™©®~$#%&/=∗。、‚׳‘"
    "’‛´`′⁄▾▵┙␥〈〉⋆⊥⊤♦♀♂●∞∙♣◆☆▪□■▶►▲▼▸‖～［］\n\t\r\f\u00ad\uf020\u008D\u00a0\uf020\u2003\u202f"
    "\u2009\u2002\u2005\u200a\u2006\u200b\u2008\u2004\u2000\u008E\u3000\uf0e0\uf07d\uf07a\uf076"
    "\uf073\uf072\uf070\uf06e\uf06d\uf06c\uf064\uf062\uf061\uf05b\uf034\uf025\uf02d\ue0d5\ue004"
    "\u0084\u0094\u0093\u0097\u0085\u0091\u0092\ue011\ufffb\uf8e7\uf0d8\uf0a7\uf074\uf0e1\uf0f1"
    "\uf0e2\uf0b5\uf0b3\uf0b4\uf079\uf07e\uf0a0\uf0a8\uf0ab\uf0ad\uf0b5\uf078\uf077\uf071\uf06f"
    "\uf06b\uf067\uf0a2\uf065\uf063\uf053\uf047\uf044\uf03c\uf02a\uf000\uf0a3\uf0e8\uf0eb\uf0f7"
    "\uf0d6\uf0b7\uf0b9\uf0ba\uf0bd\uf0be\u200e\ue003\ue009\u2028\u0082\u2007\ufeff\u0096\u0099⃝◇"
    "◮║➔➢➤✉☁✣✭✩✴✳✿➝✦✸❛❖✞♯◌◊⌜♮❚♠❯☞┚⌈➀➁➂➃➄△≈∥\uf075‵※『と⁎₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹⿿⩾⦁⋄✰⪡⪢"
    "\uf080\uf081\uf082\uf083\uf084\uf085\uf086\uf087\uf088\uf089"
)
AUTHORS = " （），･·;,-―−—–‑‐&@“”„、ᆞ⋅‧•†‡‹↑'׳′´`’‘ʿ．.©\"‟«»*∗()#\n\r\u00ad\u200e\u2009"
VENUE = " -–™®?*=#&\\/!|\";[]():'´+,’.@\n\r\u00ad"
JOURNAL = " -[]()&“”,?.:+/*'’ʿ´;@!\"\n\r\u00ad"
ENTITIES = " -–:,;_!^\"<>[]()./’'*&@\n\r"
PLAIN = " \n\r"
QUERY = " “”/\"-.，[](),?+#*'"

#: Field to delimiters; fields not named here use PLAIN.
DELIMITERS = {"title": TITLE, "abstract": TITLE, "authors": AUTHORS, "venue": VENUE, "journal": JOURNAL, "entities": ENTITIES}

#: English function words, for where no list is given; a full list is read from a file (`sources.corpus.stopwords`).
ENGLISH = tuple(
    "a about after all also an and any are as at be been but by can could did do for from had has have he her him his how i if in into is it its "
    "me more most my no nor not of off on or other our out over own same she should so some such than that the their them then there these they "
    "this those through to too under until up very was we were what when where which while who why will with would you your".split()
)


def spaced(text: Column, delimiters: str) -> Column:
    """Every delimiter as a space: one pass, in generated code."""
    seen = "".join(dict.fromkeys(delimiters))
    return F.translate(text, seen, " " * len(seen))


def tokens(text: Column, delimiters: str) -> Column:
    """Array of the tokens between delimiters, never empty ones, in order and in their own case. Null text: none."""
    return F.array_remove(F.split(spaced(F.coalesce(text, F.lit("")), delimiters), " "), "")


def not_stopword(token: Column, stopwords: Iterable[str]) -> Column:
    """Whether the lower-case token isn't in the list. The list is a literal set, so the test needs no join."""
    words = sorted(set(stopwords))
    return ~F.lower(token).isin(words) if words else F.lit(True)


def terms(rows: DataFrame, token: str, stopwords: Iterable[str] = (), stemmer: bool = False) -> DataFrame:
    """rows with the column `term` for each token: stop words go first, stems are of the token's own case, then lower."""
    kept = rows.where(not_stopword(F.col(token), stopwords))
    if not stemmer:
        return kept.withColumn("term", F.lower(token))
    return stemmed(kept, token, "_stem").withColumn("term", F.lower("_stem")).drop("_stem")


def query_terms(queries: DataFrame, stopwords: Iterable[str] = (), stemmer: bool = False) -> DataFrame:
    """(query_id, pos, term, weight 1.0) from (query_id, query); the query's own delimiters, positions from 0."""
    found = queries.select("query_id", F.posexplode(tokens(F.col("query"), QUERY)).alias("pos", "token"))
    return terms(found, "token", stopwords, stemmer).select("query_id", "pos", "term", F.lit(1.0).alias("weight"))
