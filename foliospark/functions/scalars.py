"""Scalar functions: rounding, durations, display strings, record sizes, tags."""

from __future__ import annotations

import math
import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")

# Nanoseconds in each unit.
HOUR, MINUTE, SECOND, MILLI = 3_600_000_000_000, 60_000_000_000, 1_000_000_000, 1_000_000
# Part-of-speech tags to the four open classes.
PARTS_OF_SPEECH = {
    "noun": ("NN", "NNS", "NNP", "NNPS"),
    "verb": ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ"),
    "adjective": ("JJ", "JJR", "JJS"),
    "adverb": ("RB", "RBR", "RBS"),
}


def ratio(n: Column, d: Column) -> Column:
    """n / d, and NaN where d is 0: ANSI division would raise."""
    return F.when(d == 0, F.lit(NAN)).otherwise(n / d)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def round_half_up(value: float, digits: int) -> float:
    """Half away from zero; NaN and infinities pass."""
    return value if math.isnan(value) or math.isinf(value) else float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def _rounded(x: Column, digits: int = 0) -> Column:
    scale = 10**digits
    out = F.floor(x * scale + 0.5)
    return (out / scale).cast("string") if digits else out.cast("long").cast("string")


def duration(ns: Column) -> Column:
    """Nanoseconds in the tier of their size: over an hour '1h 2m', over a minute '1m 2s', then s, then ms.

    Over 20 s whole seconds, over 2 s one decimal, over 100 ms two; over 20 ms whole milliseconds, over 2 ms one
    decimal, else two. Rounded half up; the smaller unit of two may round to 60.
    """
    second, milli = ns / SECOND, ns / MILLI
    return (
        F.when(ns > HOUR, F.concat(F.floor(ns / HOUR).cast("string"), F.lit("h "), _rounded(ns % HOUR / MINUTE), F.lit("m")))
        .when(ns > MINUTE, F.concat(F.floor(ns / MINUTE).cast("string"), F.lit("m "), _rounded(ns % MINUTE / SECOND), F.lit("s")))
        .when(ns > 20 * SECOND, F.concat(_rounded(second), F.lit("s")))
        .when(ns > 2 * SECOND, F.concat(_rounded(second, 1), F.lit("s")))
        .when(ns > 100 * MILLI, F.concat(_rounded(second, 2), F.lit("s")))
        .when(ns > 20 * MILLI, F.concat(_rounded(milli), F.lit("ms")))
        .when(ns > 2 * MILLI, F.concat(_rounded(milli, 1), F.lit("ms")))
        .otherwise(F.concat(_rounded(milli, 2), F.lit("ms")))
    )


def author_names(authors: Column) -> Column:
    """Names joined by commas; a null name is empty."""
    return F.array_join(F.transform(F.coalesce(authors, F.array()), lambda a: F.coalesce(a["name"], F.lit(""))), ",")


def author_ids(authors: Column) -> Column:
    """Each author's ids as [1, 2], joined by commas."""
    return F.array_join(F.transform(F.coalesce(authors, F.array()), lambda a: F.concat(F.lit("["), F.array_join(F.coalesce(a["ids"], F.array()), ", "), F.lit("]"))), ",")


def record_size(title: Column, names: Column, ids: Column, journal: Column) -> Column:
    """Bytes of a display record: 16 of year and lengths, and the UTF-8 of its strings."""
    return (F.lit(16) + F.octet_length(title) + F.octet_length(names) + F.octet_length(ids) + F.octet_length(journal)).cast("long")


def word_class(tag: Column) -> Column:
    """noun, verb, adjective or adverb for a part-of-speech tag, else null."""
    out = None
    for name, tags in PARTS_OF_SPEECH.items():
        hit = tag.isin(*tags)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def untagged(tagged: Column) -> tuple[Column, Column]:
    """The first two parts of word_TAG between underscores."""
    parts = F.split(tagged, "_")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def stamped(name: str, instant: str) -> str:
    """A file name with the time before its last dot, colons as dots."""
    head, dot, tail = name.rpartition(".")
    stamp = "_" + instant.replace(":", ".")
    return f"{head}{stamp}.{tail}" if dot else name + stamp


def byte_size(literal: str) -> int:
    """'2GB' and the like in bytes; units of 1024."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([KMGTP]?)B\s*", literal)
    if not m:
        raise ValueError(f"not a byte size: {literal!r}")
    return int(float(m[1]) * 1024 ** " KMGTP".index(m[2] or " "))
