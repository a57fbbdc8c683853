"""Text functions: entities, sentiment, keywords, normalisation, tokens, deterministic vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the functions' contract.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\+?[\d\s-]{10,}"
URL = r"https?://[^\s]+"
POSITIVE = ["good", "great", "excellent", "amazing", "wonderful", "fantastic", "love", "best", "happy", "awesome"]
NEGATIVE = ["bad", "terrible", "awful", "horrible", "worst", "hate", "sad", "angry", "disappointing", "poor"]
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "been",
    "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "this", "that", "these", "those", "it",
]
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
VOCABULARY = 30522
DIMENSION = 384


def emails(text) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def phones(text) -> Column:
    return F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))


def urls(text) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def persons(text) -> Column:
    """The first five capitalised words of more than three bytes, without marks at their ends."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"^\p{Lu}") & (F.octet_length(w) > 2))
    return F.slice(F.filter(F.transform(words, lambda w: F.regexp_replace(w, EDGE, "")), lambda w: F.octet_length(w) > 3), 1, 5)


def sentiment_hits(text) -> Column:
    """Positive words contained in the lower-cased text, less negative ones."""
    low = F.lower(text)
    count = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    return count(POSITIVE) - count(NEGATIVE)


def sentiment(text) -> Column:
    """Struct ``sentiment, score, confidence``; a tenth per hit, neutral up to one hit either way."""
    hits = sentiment_hits(text)
    label = F.when(hits > 1, "positive").when(hits < -1, "negative").otherwise("neutral")
    return F.struct(label.alias("sentiment"), (hits / 10).alias("score"), F.least(F.abs(hits) / 50, F.lit(1.0)).alias("confidence"))


def keywords(rows: DataFrame, id_col: str, text_col: str, k: int = 10) -> DataFrame:
    """``id, keyword, n, rank``: most frequent words (as written) that aren't stop words, ties by word."""
    words = rows.select(id_col, F.explode(F.split(text_col, r"\s+")).alias("w")).select(id_col, F.regexp_replace("w", EDGE, "").alias("keyword"))
    words = words.where((F.octet_length("keyword") > 2) & ~F.lower("keyword").isin(STOP_WORDS))
    counts = words.groupBy(id_col, "keyword").agg(F.count("*").alias("n"))
    order = Window.partitionBy(id_col).orderBy(F.col("n").desc(), "keyword")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def normalized(text, most: int | None = None) -> Column:
    """Without marks, line feeds as blanks, lower case, the first ``most`` characters."""
    out = F.lower(F.replace(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""), F.lit("\n"), F.lit(" ")))
    return F.substring(out, 1, most) if most else out


def token_lengths(text) -> Column:
    """Bytes of each word, modulo the vocabulary's size."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.octet_length(w) % VOCABULARY)


def vectorize(text, dimension: int = DIMENSION) -> Column:
    """A vector of length 1 that depends on the text alone; not the numbers of any trained model."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.pmod(F.xxhash64(text, i), F.lit(20001)).cast("double") / 10000 - 1)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.element_at(F.transform(F.array(raw), lambda v: F.element_at(F.transform(F.array(length(v)), lambda n: F.transform(v, lambda x: x / n)), 1)), 1)


def rewrite_operators(query) -> Column:
    """AND and OR as && and ||."""
    return F.replace(F.replace(query, F.lit(" AND "), F.lit(" && ")), F.lit(" OR "), F.lit(" || "))
