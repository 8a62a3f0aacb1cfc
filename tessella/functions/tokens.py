"""A text-search tokenizer in the JVM: typed tokens by one pattern, and stems of the distinct tokens only.

typed_tokens is a column expression: one alternation, applied by regexp_extract_all, finds the tokens, and their types follow from
their shape. A hyphenated compound is followed by its parts, a url by its host and path. White space and punctuation are no tokens.

Stems come from a dictionary: the distinct tokens of the counted terms are stemmed once in Arrow batches and joined back, so that
Python sees each word of a corpus once, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .stemmer import STOP_WORDS, stem

#: Numbers of the token types of the usual text-search parser.
ASCII_WORD, WORD, NUM_WORD, EMAIL, URL, HOST, SFLOAT, VERSION = 1, 2, 3, 4, 5, 6, 7, 8
NUM_PART, PART, ASCII_PART, BLANK, TAG, PROTOCOL, NUM_COMPOUND, ASCII_COMPOUND, COMPOUND, URL_PATH = 9, 10, 11, 12, 13, 14, 15, 16, 17, 18
FLOAT, INT, UINT, ENTITY = 20, 21, 22, 23

_WORD = r"[\p{L}\p{N}]"
#: The alternatives in the order in which they are tried. Java's matcher recurses once for each turn of a group, so that
#: these are bounded: a compound of more than 100 parts is several tokens.
SHAPES = {
    "tag": r"</?[A-Za-z][^<>]*>",
    "entity": r"&(?:[A-Za-z]+|#[0-9]+);",
    "email": r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+){1,20}",
    "protocol": r"[a-z]+://",
    "host": r"(?:[\p{L}\p{N}_-]+\.){1,20}[a-z]{2,}(?:/[^ \t\n\x0B\f\r<>\"]*)?",
    "version": r"[0-9]+(?:\.[0-9]+){2,20}",
    "float": r"[+-]?[0-9]+\.[0-9]+(?:[eE][+-]?[0-9]+)?",
    "int": r"[+-][0-9]+",
    "compound": r"\p{L}[\p{L}\p{N}]*(?:-[\p{L}\p{N}]+){1,100}",
    "word": r"[\p{L}\p{N}]+",
}
PATTERN = "|".join(SHAPES.values())

_TYPED = "array<struct<type:int,token:string>>"


def _is(token: Column, *shapes: str) -> Column:
    return token.rlike("^(?:" + "|".join(shapes) + ")$")


def _word_type(token: Column, ascii_: int, letters: int, mixed: int) -> Column:
    return F.when(_is(token, "[A-Za-z]+"), ascii_).when(_is(token, r"\p{L}+"), letters).otherwise(mixed)


def _typed(token: Column) -> Column:
    """The token with its type, and what follows from it."""

    def one(kind: Column | int, value: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, int) else kind).cast("int").alias("type"), value.alias("token"))

    slash = F.instr(token, "/")
    url = F.array(one(URL, token), one(HOST, F.substring(token, F.lit(1), slash - 1)), one(URL_PATH, F.substring(token, slash, F.length(token))))
    compound = F.when(_is(token, "[A-Za-z-]+"), ASCII_COMPOUND).when(_is(token, r"[\p{L}-]+"), COMPOUND).otherwise(NUM_COMPOUND)
    parts = F.transform(F.split(token, "-"), lambda p: one(_word_type(p, ASCII_PART, PART, NUM_PART), p))
    number = F.when(_is(token, SHAPES["int"]), INT).when(_is(token, SHAPES["version"]), VERSION).when(_is(token, ".*[eE].*"), SFLOAT).otherwise(FLOAT)
    return (
        F.when(_is(token, "[A-Za-z]+"), F.array(one(ASCII_WORD, token)))
        .when(_is(token, "[0-9]+"), F.array(one(UINT, token)))
        .when(_is(token, SHAPES["word"]), F.array(one(_word_type(token, ASCII_WORD, WORD, NUM_WORD), token)))
        .when(F.substring(token, 1, 1) == "<", F.array(one(TAG, token)))
        .when(F.substring(token, 1, 1) == "&", F.array(one(ENTITY, token)))
        .when(_is(token, SHAPES["email"]), F.array(one(EMAIL, token)))
        .when(_is(token, SHAPES["protocol"]), F.array(one(PROTOCOL, token)))
        .when(_is(token, SHAPES["host"]), F.when(slash > 0, url).otherwise(F.array(one(HOST, token))))
        .when(_is(token, SHAPES["compound"]), F.concat(F.array(one(compound, token)), parts))
        .otherwise(F.array(one(number, token)))
    )


def spans_of(text: Column) -> Column:
    """What the pattern finds in a text, in order: a token each, or a compound or url that is several; none of a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def typed_tokens(text: Column) -> Column:
    """All tokens of a text in order, as (type, token); none of a null text."""
    return F.flatten(F.transform(spans_of(text), _typed))


@lru_cache(1 << 17)
def lexeme(token: str) -> str:
    """The stem of a token in lower case; empty for a stop word."""
    low = token.lower()
    return "" if low in STOP_WORDS else stem(low)


@F.pandas_udf(StringType())
def _lexemes(tokens: pd.Series) -> pd.Series:
    return tokens.map(lexeme)


@F.pandas_udf(ArrayType(StringType()))
def _lexeme_lists(lists: pd.Series) -> pd.Series:
    return lists.map(lambda tokens: [lexeme(t) for t in tokens])


def dictionary(tokens: DataFrame) -> DataFrame:
    """(token, stem) of the distinct tokens."""
    return tokens.select("token").distinct().withColumn("stem", _lexemes("token"))


class StemTokenizer:
    """Stems of the tokens that keep chooses; with_type puts the type and two bars before the stem, else stop words are dropped.

    Called with a column it gives the stems of each text as an array. counts and rows work on whole tables by a dictionary.
    """

    def __init__(self, keep: Callable[[Column], Column], with_type: bool = False) -> None:
        self.keep, self.with_type = keep, with_type

    def spans(self, text: Column) -> Column:
        return spans_of(text)

    def tokens(self, text: Column) -> Column:
        return F.filter(typed_tokens(text), self.keep)

    def _by_spans(self, rows: DataFrame, keys: list[str], text: str) -> DataFrame:
        """(keys, type, token, stem, c): spans are counted as they stand; only the distinct ones get types and stems, in one join."""
        spans = rows.select(*keys, F.explode(self.spans(F.col(text))).alias("span")).groupBy(*keys, "span").agg(F.count("*").alias("c")).checkpoint()
        typed = spans.select("span").distinct().select("span", F.inline(F.filter(_typed(F.col("span")), self.keep)))
        return spans.join(typed.withColumn("stem", _lexemes("token")), "span").drop("span")

    def __call__(self, text: Column) -> Column:
        found = self.tokens(text)
        stems = _lexeme_lists(F.transform(found, lambda t: t["token"]))
        if self.with_type:
            return F.transform(F.arrays_zip(F.transform(found, lambda t: t["type"]).alias("k"), stems.alias("s")), lambda z: F.concat(z["k"].cast("string"), F.lit("||"), z["s"]))
        return F.filter(stems, lambda s: s != "")

    def counts(self, rows: DataFrame, keys: list[str], text: str, name: str = "term") -> DataFrame:
        """(keys, name, c): how often each stem occurs for each key. Counted tokens are written once."""
        joined = self._by_spans(rows, keys, text)
        if self.with_type:
            term = F.concat(F.col("type").cast("string"), F.lit("||"), F.col("stem"))
        else:
            joined, term = joined.where("stem <> ''"), F.col("stem")
        return joined.select(*keys, term.alias(name), "c").groupBy(*keys, name).agg(F.sum("c").alias("c"))


class _AsciiStemTokenizer(StemTokenizer):
    """Of ASCII words only: these are spans of their own, told by one pattern, so that no other span needs a type."""

    def spans(self, text: Column) -> Column:
        return F.filter(spans_of(text), lambda t: _is(t, "[A-Za-z]+"))

    def tokens(self, text: Column) -> Column:
        return F.filter(F.transform(self.spans(text), lambda t: F.struct(F.lit(ASCII_WORD).alias("type"), t.alias("token"))), self.keep)


def _shorter(n: int) -> Callable[[Column], Column]:
    return lambda t: F.length(t["token"]) < n


#: Type number, two bars and stem of each token shorter than 2048; a stop word's stem is empty.
typed_stems = StemTokenizer(_shorter(2048), with_type=True)
#: Stems of tokens shorter than 200; stop words are dropped.
stems = StemTokenizer(_shorter(200))
#: Stems of all ASCII words shorter than 100; stop words are dropped.
word_stems = _AsciiStemTokenizer(lambda t: (t["type"] == ASCII_WORD) & (F.length(t["token"]) < 100))
#: Stems of all tokens shorter than 100 but unsigned numbers.
topic_stems = StemTokenizer(lambda t: (t["type"] != UINT) & (F.length(t["token"]) < 100))
