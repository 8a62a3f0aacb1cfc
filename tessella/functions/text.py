"""Text functions: q-grams, substrings and filters, as column expressions or Arrow-batched UDFs; tokenizers are in tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .tokens import stems, typed_stems, word_stems  # noqa: F401

STRINGS = ArrayType(StringType())


def _chars(text: Column) -> Column:
    """Positions 1..length(text); empty for the empty text (sequence counts down from 1 to 0 otherwise)."""
    return F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))


def qgrams(text: Column, q: int = 3) -> Column:
    """The bag of q-grams of a text, as an array with repeats.

    The text is put in lower case and split at white space. Each word gives its first q characters followed by ``!``, its
    first character followed by ``#``, its first character with the first of the next word (if there is one), and every
    contiguous q-gram. Null and blank texts give an empty array.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")

    def of(w: Column, i: Column) -> Column:
        marks = F.array(F.concat(F.substring(w, 1, q), F.lit("!")), F.concat(F.substring(w, 1, 1), F.lit("#")))
        following = F.get(words, i + 1)
        pair = F.when(following.isNotNull(), F.array(F.concat(F.substring(w, 1, 1), F.lit(" "), F.substring(following, 1, 1)))).otherwise(F.array().cast("array<string>"))
        last = F.length(w) - (q - 1)
        runs = F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda p: F.substring(w, p, F.lit(q)))).otherwise(F.array().cast("array<string>"))
        return F.concat(marks, pair, runs)

    return F.flatten(F.transform(words, of))


def prefixes(text: Column) -> Column:
    """All non-empty prefixes, shortest first."""
    return F.transform(_chars(text), lambda i: F.substring(text, F.lit(1), i))


def substrings(text: Column) -> Column:
    """Distinct non-empty substrings."""
    return F.array_distinct(F.flatten(F.transform(_chars(text), lambda i: F.transform(F.sequence(F.lit(1), F.length(text) - i + 1), lambda n: F.substring(text, i, n)))))


def remove_substrings(target: Column, removals: Column) -> Column:
    """For each of the comma-separated removals, longest first, its first case-insensitive occurrence is cut out."""
    parts = F.filter(F.split(F.coalesce(removals, F.lit("")), ","), lambda p: p != "")
    ordered = F.array_sort(parts, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))

    def cut(s: Column, p: Column) -> Column:
        at = F.instr(F.lower(s), F.lower(p))
        return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + F.length(p), F.length(s)))).otherwise(s)

    return F.aggregate(ordered, target, cut)


def text_filter(text: Column, terms: Column) -> Column:
    """Whether the text holds every space-separated term, in any case; no terms hold always."""
    return F.forall(F.split(F.lower(terms), " "), lambda t: F.contains(F.lower(text), t))


def text_filter_terms(text: Column, terms: str) -> Column:
    return text_filter(text, F.lit(terms))


def _kind(char: str) -> str:
    """What a character is to the scan for boundaries: a delimiter, a digit, a plain small or capital letter, or other."""
    if not char.isalnum():
        return "delimiter"
    if char.isdecimal():
        return "digit"
    return "other" if not char.isascii() else "small" if char.islower() else "capital"


def cut_points(text: str) -> list[int]:
    """Both ends, and one past the first character of each boundary.

    A delimiter is a boundary, and so is what stands before one. A capital after a small letter, and a change between
    digits and others, are boundaries of two characters; the scan goes on behind them, so that a second boundary that begins
    with the latter character is not seen.
    """
    kinds, cuts, skip = [_kind(c) for c in text], {0, len(text)}, False
    for at, (here, after) in enumerate(pairwise([*kinds, "end"])):
        if skip:
            skip = False
        elif "delimiter" in (here, after):
            cuts.add(at + 1)
        elif after != "end" and ((here, after) == ("small", "capital") or (here == "digit") != (after == "digit")):
            cuts.add(at + 1)
            skip = True
    return sorted(cuts)


def delimited_substrings(text: str) -> list[str]:
    """Distinct spans between any two cut points."""
    cuts = cut_points(text)
    return sorted({text[low:high] for n, low in enumerate(cuts) for high in cuts[n + 1 :]})


@F.pandas_udf(STRINGS)
def delimited(texts: pd.Series) -> pd.Series:
    """delimited_substrings of each text; null for null."""
    return texts.map(lambda t: None if t is None else delimited_substrings(t))


def partitions(text: str) -> Iterator[list[str]]:
    """All ways to cut a text into non-empty parts, in a row; two to the power of its length less one."""
    for cuts in range(1 << (len(text) - 1) if text else 0):
        at = [0, *(i for i in range(1, len(text)) if cuts >> (i - 1) & 1), len(text)]
        yield [text[low:high] for low, high in pairwise(at)]


def string_partitions(rows: DataFrame, column: str, name: str = "parts", batch: int = 8192) -> DataFrame:
    """rows of (column, parts), one for each partition of each text, made and passed on some at a time; null and empty texts have none."""

    def run(frames):
        for frame in frames:
            for value in frame[column]:
                waiting = []
                for parts in partitions(value or ""):
                    waiting.append((value, parts))
                    if len(waiting) == batch:
                        yield pd.DataFrame(waiting, columns=[column, name])
                        waiting = []
                if waiting:
                    yield pd.DataFrame(waiting, columns=[column, name])

    return rows.select(column).mapInPandas(run, f"`{column}` string, `{name}` array<string>")


def check_identifier(name: str) -> str:
    """The name, quoted for SQL; ValueError unless letters, digits and underscores make it up."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return ".".join(f"`{p}`" for p in name.split("."))
