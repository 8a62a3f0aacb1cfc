"""URL verdicts: suffix rules first, else logistic regression on hashed character n-grams of host and path.

A url's host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; its
path is the rest up to ``?``, ``#`` or the end. A rule fits its host and all subdomains if the path starts with the
rule's path; the longest rule that fits wins.

The regression is trained by Spark on a small labelled table of urls (the one here, made by a rule, or the caller's own); its features
are counts of the n-grams of host and path, hashed into FEATURES numbers. Of a host whose words no url of the table holds it
judges by shape alone (hyphens, numbers, endings, paths): callers with labelled urls of their own should pass them.

Edge cases: a null url or one without ``://`` has an empty host and path and is judged by the method on its whole text
(empty if null); empty hosts fit no rule; repeated rows are judged each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES, SIZES = 1 << 16, (3, 4, 5)
#: Fixed values: (verdict, host, path) of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Words of the small labelled table: terms of public block list categories (gambling, medicines, adult content, malware, fraud, advertising), and of
#: ordinary kinds of sites. No host name of a given table is among them, whole or in parts: tests hold the table against the pages.
UNWANTED = (
    "poker", "roulette", "jackpot", "lottery", "wager", "baccarat", "slotmachine", "gambling", "viagra", "steroid", "pharmacy", "opioid", "dietpowder",
    "porn", "erotic", "escort", "nudes", "hookup", "malware", "phishing", "trojan", "botnet", "warez", "keygen", "torrent", "payday", "ponzi", "pyramid",
    "counterfeit", "replica", "giveaway", "sweepstake", "prize", "popunder", "clickbait", "doorway", "affiliate", "banner", "bulkmail", "miracle",
)
ORDINARY = (
    "library", "university", "weather", "recipes", "history", "science", "museum", "orchestra", "hospital", "railway", "parliament", "physics", "poetry",
    "football", "sailing", "architecture", "software", "kernel", "database", "bakery", "theatre", "gallery", "furniture", "bicycle", "energy", "mountain",
    "astronomy", "geology", "biology", "dictionary", "encyclopedia", "kindergarten", "volunteers", "foundation", "education", "photography", "language",
    "newspaper", "harbour", "observatory",
)
#: What both kinds add to their words.
MODIFIERS = ("online", "24", "shop", "live", "club", "zone", "hub", "my", "top", "world", "city", "blog")
#: Shapes by which the kinds differ: how many urls in a hundred have a hyphen and a number in the host, and their endings and paths.
HYPHENS, NUMBERS = (70, 20), (40, 10)
ENDINGS = (("xyz", "top", "click", "biz", "info", "com", "net"), ("org", "edu", "gov", "com", "net", "de", "fr"))
PATHS = (("/", "/go/7731", "/promo", "/click?id=5", "/offer/1", ""), ("/", "/about", "/articles/2020/05", "/docs/index.html", "/people/1", ""))
HOSTS = 8


def labelled_rows() -> list[tuple[str, str, float]]:
    """(url, word, label) of the table; label 1 is unwanted. Every choice is the CRC-32 of word and turn."""
    rows = []
    for kind, words in enumerate((UNWANTED, ORDINARY)):
        for word in words:
            for turn in range(HOSTS):
                draw = lambda what, n: zlib.crc32(f"{word} {turn} {what}".encode()) % n  # noqa: B023, E731
                other = MODIFIERS[draw("modifier", len(MODIFIERS))]
                dash = "-" if draw("hyphen", 100) < HYPHENS[kind] else ""
                number = str(draw("digits", 900) + 100) if draw("number", 100) < NUMBERS[kind] else ""
                name = f"{word}{dash}{other}" if draw("order", 2) else f"{other}{dash}{word}"
                host = f"{('', 'www.', 'm.')[draw('subdomain', 3)]}{name}{number}.{ENDINGS[kind][draw('ending', len(ENDINGS[kind]))]}"
                rows.append((f"https://{host}{PATHS[kind][draw('path', len(PATHS[kind]))]}", word, 1.0 - kind))
    return rows


def labelled(spark: SparkSession) -> DataFrame:
    """labelled_rows as (url, word, label)."""
    return spark.createDataFrame(labelled_rows(), "url string, word string, label double")


def split_url(url) -> tuple:
    """Columns host and path of a url column."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def ngrams(text):
    """All character n-grams of the sizes SIZES, as an array."""

    def of(n):
        last = F.length(text) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in SIZES])


def features(urls: DataFrame) -> DataFrame:
    """urls (host, path, whole) with their hashed n-grams; host and path n-grams are told apart by a mark."""
    host, path = F.concat(F.lit("^"), F.col("host"), F.lit("$")), F.concat(F.lit(">"), F.col("path"), F.lit("<"))
    parts = F.when(F.col("host") == "", ngrams(F.concat(F.lit("^"), F.coalesce(F.col("url"), F.lit("")), F.lit("$")))).otherwise(F.concat(F.transform(ngrams(host), lambda g: F.concat(F.lit("h"), g)), F.transform(ngrams(path), lambda g: F.concat(F.lit("p"), g))))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES).transform(urls.withColumn("grams", parts))


def train(examples: DataFrame) -> LogisticRegressionModel:
    """The model of (url, label)."""
    host, path = split_url(F.col("url"))
    rows = features(examples.select("url", host.alias("host"), path.alias("path"), "label"))
    return LogisticRegression(regParam=0.01, maxIter=200, tol=1e-9).fit(rows.select("features", "label"))


def judge(pages: DataFrame, rules=RULES, examples: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    model = train(labelled(pages.sparkSession) if examples is None else examples)
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == own) | F.col("host").endswith(f".{own}")) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, f"{own}{start}").otherwise(rule), F.when(fits, kind).otherwise(verdict)
    scored = model.transform(features(urls.withColumns({"rule": rule, "told": verdict})))
    by_method = F.when(F.element_at(vector_to_array("probability"), 2) >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("told", by_method).alias("verdict"))
