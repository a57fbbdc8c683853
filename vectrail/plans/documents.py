"""Field filters and their combinations, JSON, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters
from ..operators.builder import QueryBuilder
from ..tables import table
from .registry import query

C = F.col


def _filter(name: str, condition: str, field: str, op: str, value) -> None:
    def run(spark, d) -> DataFrame:
        return table(spark, d, "events").where(filters.predicate(field, op, value)).select("event_id", "event_type", "value")

    run.__name__ = name
    query(f"SELECT event_id, event_type, value FROM events WHERE {condition}")(run)


_filter("filter_eq", "event_type = 'click'", "event_type", "eq", "click")
_filter("filter_ne", "event_type <> 'click'", "event_type", "ne", "click")
_filter("filter_range", "value >= 25.0", "value", "gte", 25.0)
_filter("filter_contains", "contains(event_type, 'r')", "event_type", "contains", "r")
_filter("filter_not_contains", "NOT contains(event_type, 'r')", "event_type", "not_contains", "r")
_filter("filter_in", "event_type IN ('view', 'error')", "event_type", "in", ["view", "error"])
_filter("filter_not_in", "event_type NOT IN ('view', 'error')", "event_type", "not_in", ["view", "error"])


def _legs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = table(spark, d, "events").select(C("event_id").alias("document_id"), "event_type", "value")
    cheap = events.where(filters.predicate("value", "lt", 30.0)).select("document_id", (C("value") / 100).alias("score"))
    clicks = events.where(filters.predicate("event_type", "eq", "click")).select("document_id", F.lit(1.0).alias("score"))
    return events, cheap, clicks


@query("SELECT event_id AS document_id, round(value / 100, 6) AS score FROM events WHERE value < 30 AND event_type = 'click'")
def compound_and(spark, d) -> DataFrame:
    _, cheap, clicks = _legs(spark, d)
    return filters.intersection([cheap, clicks]).select("document_id", F.round("score", 6).alias("score"))


@query("SELECT event_id AS document_id, CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE round(value / 100, 6) END AS score FROM events WHERE value < 30 OR event_type = 'click'")
def compound_or(spark, d) -> DataFrame:
    _, cheap, clicks = _legs(spark, d)
    return filters.union([cheap, clicks]).select("document_id", F.round("score", 6).alias("score"))


@query("SELECT event_id AS document_id FROM events WHERE (event_type = 'click') IS NOT TRUE")
def compound_not(spark, d) -> DataFrame:
    events, _, clicks = _legs(spark, d)
    return filters.complement(events, clicks).select("document_id")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_extract(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("""SELECT document_id, score, rank FROM (SELECT *, row_number() OVER (ORDER BY value DESC, document_id) AS rank FROM (
SELECT event_id AS document_id, value, NULL::DOUBLE AS score FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 20 OFFSET 5))""")
def result_rank(spark, d) -> DataFrame:
    """The builder on a scalar filter: sorted by a field, paged, ranked from 1 on the page."""
    found = QueryBuilder("events").filter("event_type", "eq", "purchase").sort("value", ascending=False).offset(5).limit(20)
    return found.run(table(spark, d, "events"), id_col="event_id").select("document_id", "score", "rank")


# text
@query(f"SELECT doc_id, len(regexp_extract_all(text, '{T.EMAIL}')) AS n, coalesce(array_to_string(regexp_extract_all(text, '{T.EMAIL}'), ' '), '') AS found FROM documents")
def extract_emails(spark, d) -> DataFrame:
    found = T.emails(C("text"))
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("found"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{T.URL}')) AS n, coalesce(array_to_string(regexp_extract_all(text, '{T.URL}'), ' '), '') AS found FROM documents")
def extract_urls(spark, d) -> DataFrame:
    found = T.urls(C("text"))
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("found"))


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '{T.PHONE}')) AS n FROM documents")
def extract_phones(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.phones(C("text"))).cast("long").alias("n"))


@query(rf"""SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '^\p{{Lu}}') AND strlen(w) > 2),
lambda w: regexp_replace(w, '{T.EDGE}', '', 'g')), lambda w: strlen(w) > 3), 1, 5), ' ') AS persons FROM documents""")
def extract_persons(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(T.persons(C("text")), " ").alias("persons"))


def _hits(words: list[str]) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)


@query(f"SELECT doc_id, hits, CASE WHEN hits > 1 THEN 'positive' WHEN hits < -1 THEN 'negative' ELSE 'neutral' END AS sentiment, round(hits / 10.0::DOUBLE, 6) AS score, round(least(abs(hits) / 50.0::DOUBLE, 1), 6) AS confidence FROM (SELECT doc_id, ({_hits(T.POSITIVE)} - ({_hits(T.NEGATIVE)}))::INT AS hits FROM documents)")
def sentiment(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", T.sentiment_hits(C("text")).alias("hits"), T.sentiment(C("text")).alias("s"))
    return rows.select("doc_id", "hits", "s.sentiment", F.round("s.score", 6).alias("score"), F.round("s.confidence", 6).alias("confidence"))


@query(rf"""SELECT doc_id, keyword, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, keyword) AS rank FROM (
SELECT doc_id, keyword, count(*) AS n FROM (SELECT doc_id, regexp_replace(w, '{T.EDGE}', '', 'g') AS keyword FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents))
WHERE strlen(keyword) > 2 AND lower(keyword) NOT IN ({', '.join(f"'{w}'" for w in T.STOP_WORDS)}) GROUP BY doc_id, keyword)) WHERE rank <= 10""")
def keywords(spark, d) -> DataFrame:
    return T.keywords(table(spark, d, "documents"), "doc_id", "text")


@query(r"SELECT doc_id, md5(lower(replace(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g'), chr(10), ' '))) AS digest FROM documents")
def text_normalize(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalized(C("text"))).alias("digest"))


@query(rf"SELECT doc_id, len(t) AS n, coalesce(list_sum(list_transform(t, lambda w: strlen(w) % {T.VOCABULARY})), 0)::BIGINT AS total FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS t FROM documents)")
def token_lengths(spark, d) -> DataFrame:
    tokens = T.token_lengths(C("text"))
    return table(spark, d, "documents").select("doc_id", F.size(tokens).cast("long").alias("n"), F.aggregate(tokens, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query()
def vectorize(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.vectorize(C("text")).alias("vector"))


@query(r"SELECT lower(w) AS term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) WHERE w <> '' GROUP BY lower(w)")
def inverted_index(spark, d) -> DataFrame:
    """Postings of all words: how often and in how many documents."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''")
    postings = words.groupBy(F.lower("w").alias("term"), "doc_id").agg(F.count("*").alias("n"))
    return postings.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))
