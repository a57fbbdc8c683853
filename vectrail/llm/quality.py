"""Quality rules by distribution divergence [native].

Two histograms of a document are compared with those of its language by Jensen-Shannon distance (base 2, so
between 0 and 1): characters by class, and words by the language's common words, all others being one bin.
The language references are sums over all documents of that language. A document is rejected where it fails a
base rule (fewer than 50 words, or over half of its words in repeated three-word windows), or where a distance
is over its limit and the document is long enough for that histogram to mean something (the length guards).

Repeated windows are found without leaving the row: every window is packed as 33 bits of hash and 31 bits of
position, the numbers are sorted, and neighbours of equal hash are candidates. Equal windows always share the
hash, so candidates hold every repeat; among them, windows are then compared as text, so a hash collision
changes nothing. The cost is that of sorting the document's own windows.

Defined results: null or blank text has no words and fails the base rules; a null or unknown language is a
language of its own without common words, so that only the class histogram counts; repeated rows each get a
row; extra columns are ignored unless named in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, quoted, staged, table

#: The most frequent function words of each language, lower case; a parameter.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on as with by this are or an from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec".split(),
    "es": "de la que el en y a los se del las un por con una su para es al lo".split(),
}
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "symbol": "[#*$%&|<>]+", "space": r"[\x20\x09-\x0D]+"}
BINS = max(map(len, COMMON_WORDS.values())) + 1
MIN_WORDS = 50
REPEATED_PERCENT = 50
#: Limits of the two distances, and the least characters in words and least words for them to count.
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.29
MIN_CHARS = 200
MIN_WORDS_FOR_WORDS = 100
MASK = (1 << 31) - 1


def repeated_words(words: Column, packed: Column) -> Column:
    """Words covered by three-word windows that occur twice or more; ``packed`` sorted. Both must be plain columns."""
    same = lambda i, j: F.shiftright(packed[i], 31) == F.shiftright(packed[j], 31)
    last = F.size(packed) - 1
    near = F.filter(packed, lambda x, i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), i)) | ((i < last) & same(i, F.least(i + 1, last))))
    at = lambda p, k: F.get(words, (p + k).cast("int"))
    texts = F.transform(near, lambda x: let(x.bitwiseAND(F.lit(MASK)), lambda p: F.struct(F.concat_ws(" ", at(p, 0), at(p, 1), at(p, 2)).alias("w"), p.alias("p"))))
    def positions(found: Column) -> Column:
        end = F.size(found) - 1
        alike = lambda i, j: F.get(found, i)["w"] == F.get(found, j)["w"]
        twice = F.filter(found, lambda x, i: ((i > 0) & alike(i - 1, i)) | ((i < end) & alike(i, i + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))
    return F.when(F.size(near) == 0, F.lit(0)).otherwise(let(F.sort_array(texts), positions)).cast("long")


def _vocabulary(lang: Column) -> Column:
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, words in COMMON_WORDS.items():
        out = out.when(lang == name, F.array(*map(F.lit, words)))
    return out.otherwise(F.array().cast("array<string>"))


def measured(docs: DataFrame, keep=("doc_id",), text_col="text", lang_col="lang") -> DataFrame:
    """Base columns and histograms (``classes`` and ``commons``, arrays of long) of each row of ``docs``."""
    text = F.col("t")
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    rows = docs.select(F.struct(*map(quoted, keep)).alias("kept"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(lang_col).alias("lang"))
    rows = rows.select("*", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"), F.split("t", "\n").alias("lines"), F.length("t").alias("n"))
    rows = rows.withColumns({
        "packed": F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size("words"), F.lit(3)) - 3),
            lambda i: F.shiftleft(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)), 31).bitwiseOR(i.cast("long")))),
        "worded": F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "usual": F.filter(F.transform("words", F.lower), lambda w: w.isin(every)),
        "vocabulary": _vocabulary(F.col("lang")),
        **{f"c_{name}": (F.col("n") - F.length(F.regexp_replace(text, pattern, ""))).cast("long") for name, pattern in CLASSES.items()},
    })
    rows = rows.withColumns({
        "packed": F.sort_array("packed"), "n_words": F.size("words").cast("long"),
        "n_dup_lines": (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long"),
        "counts": F.transform("vocabulary", lambda v: (F.size("usual") - F.size(F.array_remove("usual", v))).cast("long")),
    })
    other = F.col("n") - sum((F.col(f"c_{name}") for name in CLASSES), F.lit(0))
    found = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "kept", "lang", "n_words", (F.col("n") - F.col("c_space")).alias("word_chars"), F.col("c_symbol").alias("n_symbols"), "n_dup_lines",
        repeated_words(F.col("words"), F.col("packed")).alias("n_repeat_words"),
        F.array(*(F.col(f"c_{name}") for name in CLASSES), other.cast("long")).alias("classes"),
        F.concat("counts", F.array_repeat(F.lit(0).cast("long"), F.lit(BINS - 1) - F.size("counts")), F.array(F.col("n_words") - found)).alias("commons"),
    )


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; 0 where either has none."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    share = lambda x: let(total(x), lambda s: F.transform(x, lambda v: F.when(s > 0, v / s).otherwise(0.0)))
    terms = F.zip_with(share(p), share(q), lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(total(terms), F.lit(0.0)))).otherwise(0.0)


def judged(docs: DataFrame, keep=("doc_id",), **cols) -> DataFrame:
    """Measures, the two distances and the verdict (``base_failed``, ``kept_doc``) of each row of ``docs``."""
    rows = staged(measured(docs, keep, **cols))
    sums = lambda name, n: F.array(*(F.sum(F.col(name)[i]) for i in range(n))).alias(f"all_{name}")
    languages = rows.groupBy(F.col("lang").alias("of")).agg(sums("classes", len(CLASSES) + 1), sums("commons", BINS))
    rows = rows.join(languages, F.col("lang").eqNullSafe(F.col("of")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    rows = rows.withColumns({
        "class_distance": _distance(F.col("classes"), F.col("all_classes")), "word_distance": _distance(F.col("commons"), F.col("all_commons")), "base_failed": failed,
    })
    odd = (F.col("word_chars") >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE) | (F.col("n_words") >= MIN_WORDS_FOR_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    return rows.withColumn("kept_doc", ~failed & ~odd)


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    return judged(docs, keep=docs.columns).where("kept_doc").select("kept.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"))
    return rows.select("kept.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("kept_doc").alias("kept"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_DISTANCE = """CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i:
  (CASE WHEN {p}[i] > 0 THEN {p}[i] / list_sum({p}) * log2(2 * ({p}[i] / list_sum({p})) / ({p}[i] / list_sum({p}) + {q}[i] / list_sum({q}))) ELSE 0 END
   + CASE WHEN {q}[i] > 0 THEN {q}[i] / list_sum({q}) * log2(2 * ({q}[i] / list_sum({q})) / ({p}[i] / list_sum({p}) + {q}[i] / list_sum({q}))) ELSE 0 END) / 2)))) ELSE 0 END"""
SQL = {
    "op3_quality": rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
w AS (SELECT id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
r AS (SELECT id, count(DISTINCT pos) AS n_repeat FROM (
        SELECT id, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT id, i, count(*) OVER (PARTITION BY id, w) AS n FROM w) WHERE n > 1) GROUP BY id),
m AS (
  SELECT id, doc_id, lang, len(words)::BIGINT AS n_words, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         [{', '.join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))" for p in CLASSES.values())}] AS cl, length(t) AS n,
         list_transform(words, lambda x: lower(x)) AS low,
         CASE lang {' '.join(f"WHEN '{k}' THEN {_list(v)}" for k, v in COMMON_WORDS.items())} ELSE [] END AS vocabulary
  FROM d LEFT JOIN r USING (id)),
h AS (
  SELECT *, list_append(cl, n - list_sum(cl)) AS p,
         list_transform(range(1, {BINS}), lambda i: CASE WHEN i <= len(vocabulary) THEN len(list_filter(low, lambda x: x = vocabulary[i])) ELSE 0 END) AS c
  FROM m),
k AS (SELECT *, list_append(c, n_words - list_sum(c)) AS pc FROM h),
l AS (SELECT lang AS of, [{', '.join(f'sum(p[{i + 1}])' for i in range(len(CLASSES) + 1))}] AS q, [{', '.join(f'sum(pc[{i + 1}])' for i in range(BINS))}] AS qc FROM k GROUP BY lang),
x AS (SELECT doc_id, n_words, (n - cl[5])::BIGINT AS word_chars, cl[4]::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words,
             (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words) AS base_failed,
             {_DISTANCE.format(p='p', q='q')} AS cd, {_DISTANCE.format(p='pc', q='qc')} AS wd
      FROM k JOIN l ON lang IS NOT DISTINCT FROM of)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (word_chars >= {MIN_CHARS} AND cd > {MAX_CLASS_DISTANCE} OR n_words >= {MIN_WORDS_FOR_WORDS} AND wd > {MAX_WORD_DISTANCE}) AS kept
FROM x""",
}
QUERIES = {"op3_quality": op3_quality}
