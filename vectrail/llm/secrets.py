"""Secret scans by a randomness test battery [native].

Base patterns (assignments of passwords and tokens, access key ids, long hexadecimal runs) are found as they
are. Every other token of 20 or more characters of the usual encodings' alphabets goes through the battery, by
the encoding inferred from its characters (hexadecimal, base 32, 36, 52, 58, 62 or 64):

* alphabet uniformity, chi-squared: ``X = a / n * sum(count^2) - n`` for alphabet size ``a``;
* runs: the number of changes between digits, lower case, upper case and the rest;
* serial correlation at lag 1 of the characters' codes.

A token counts as random only if no test rejects randomness at |z| > MAX_Z. It is reported if, besides, ordinary
text is rejected as its origin: the distance of ``X`` and of the changes from what written words of that length
give (coincidence rate of letters, rate of changes of class), and of the letters' mean surprise, is expressed as three z
values; the largest of these and of their sum over sqrt(3) counts, as small alphabets differ from text in one only.
These grow with the length, and a short token can't reach a high value. Over the whole corpus, the false
discovery rate is held at FDR by the Benjamini-Hochberg rule within each band of lengths, on a histogram of z in
steps of 1/STEPS, which has a fixed number of cells whatever the corpus; p is bounded above by 4 exp(-z^2/2)/2.

Defined results: null text is read as empty; positions are code points, the end exclusive; a token that touches a
base span is not tested; repeated rows each get a row; extra columns are ignored unless named in ``keep``; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, quoted, staged, table

#: Fixed values of the contract: patterns and least lengths, kinds in their order.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "random")
#: Tokens end at an equals sign, other than one of padding, and at a slash where whole words stand between slashes.
TOKEN = (
    r"(?:(?<![A-Za-z0-9+/_-])(?![a-z]{2,}+/)(?![A-Za-z0-9+/_-]*?/[a-z]{2,}+/)[A-Za-z0-9+/_-]{20,}+={0,2}"
    r"|(?<![A-Za-z0-9+_-])[A-Za-z0-9+_-]{20,}+={0,2})"
)
#: Encodings in the order in which they are tried: pattern, size of the alphabet, its digits, lower and upper case letters.
ENCODINGS = (
    ("^([0-9a-f]+|[0-9A-F]+)$", 16, 10, 6, 0), ("^([A-Z2-7]+|[a-z2-7]+)=*$", 32, 6, 26, 0), ("^([0-9a-z]+|[0-9A-Z]+)$", 36, 10, 26, 0),
    ("^[A-Za-z]+$", 52, 0, 26, 26), ("^[1-9A-HJ-NP-Za-km-z]+$", 58, 9, 25, 24), ("^[0-9A-Za-z]+$", 62, 10, 26, 26), ("", 64, 10, 26, 26),
)
#: Written words: rate of equal letters, sum of cubed letter shares, rate of changes between classes.
TEXT_COINCIDENCE, TEXT_CUBES, TEXT_CHANGES = 0.066, 0.0056, 0.15
#: Shares of the letters a to z in written words, in percent; a parameter, rounded from English.
TEXT_LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
_SURPRISE = [-math.log(x / sum(TEXT_LETTERS)) for x in TEXT_LETTERS]
#: Mean and deviation of a letter's surprise in written words.
TEXT_SURPRISE = sum(x * y for x, y in zip(TEXT_LETTERS, _SURPRISE, strict=True)) / sum(TEXT_LETTERS)
TEXT_SPREAD = math.sqrt(sum(x * (y - TEXT_SURPRISE) ** 2 for x, y in zip(TEXT_LETTERS, _SURPRISE, strict=True)) / sum(TEXT_LETTERS))
MAX_Z = 4.0
FDR = 0.001
STEPS, MOST = 10, 60
BANDS = (20, 32, 64, 128)
BLOCK = 512


def _prefix(lengths: Column) -> Column:
    """Running sums of an array of int, each before its element; in blocks, so that long arrays aren't copied per element."""
    def run(xs: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    def step(a: Column, xs: Column) -> Column:
        return let(run(xs, a["at"]), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], r["out"]).alias("out")))
    return F.aggregate(blocks, zero, step, lambda a: a["out"])


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as an array of ``s, e, g``: start, end, and the text of the group."""
    none = F.array().cast("array<struct<s:int,e:int,g:string>>")
    def place(matches: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        steps = F.zip_with(gaps, F.transform(matches, F.length), lambda g, m: g + F.coalesce(m, F.lit(0)))
        groups = matches if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        whole = lambda m: let(_prefix(steps), lambda at: F.transform(
            F.arrays_zip(m.alias("m"), groups.alias("g"), at.alias("a"), gaps.alias("b")),
            lambda x: F.struct((x["a"] + x["b"]).alias("s"), (x["a"] + x["b"] + F.length(x["m"])).alias("e"), x["g"].alias("g"))))
        return F.filter(whole(matches), lambda x: x["e"].isNotNull())
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(none)


def _tested(token: Column) -> Column:
    """Struct ``z, ok`` of a token: distance from written words, and whether no test rejects randomness."""
    n = F.length(token).cast("double")
    size = F.lit(None).cast("double")
    for pattern, letters, *_ in reversed(ENCODINGS):
        size = F.when(token.rlike(pattern), float(letters)).otherwise(size)
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    def stats(chars: Column, n: Column, a: Column) -> Column:
        codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
        kind = lambda c: F.when(c.rlike("[0-9]"), 0).when(c.rlike("[a-z]"), 1).when(c.rlike("[A-Z]"), 2).otherwise(3)
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
        change = lambda k: F.aggregate(F.zip_with(F.slice(k, 1, F.size(k) - 1), F.slice(k, 2, F.size(k) - 1), lambda x, y: (x != y).cast("double")), F.lit(0.0), lambda s, x: s + x)
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
        centred = let(total(codes) / n, lambda m: F.transform(codes, lambda c: c - m))
        serial = let(centred, lambda x: total(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda u, v: u * v)) / F.greatest(total(F.transform(x, lambda v: v * v)), F.lit(1e-9)))
        letters = F.filter(F.transform(codes, lambda c: (c.cast("int").bitwiseOR(F.lit(32)) - 97)), lambda c: (c >= 0) & (c < 26))
        surprise = let(letters, lambda x: F.struct(F.aggregate(x, F.lit(0.0), lambda s, c: s + F.get(F.array(*map(F.lit, _SURPRISE)), c)).alias("sum"), F.size(x).cast("double").alias("n")))
        return F.struct(squares.alias("squares"), surprise.alias("surprise"), let(F.transform(chars, kind), change).alias("changes"), serial.alias("serial"), n.alias("n"), a.alias("a"))
    def verdict(s: Column) -> Column:
        n, a = s["n"], s["a"]
        chi = a / n * s["squares"] - n
        z_chi = (chi - (a - 1)) / F.sqrt(2 * (a - 1))
        rate = F.lit(None).cast("double")  # of changes between classes, in random characters
        for _, letters, *classes in ENCODINGS:
            rest = letters - sum(classes)
            rate = F.when(a == letters, 1 - sum(x * x for x in (*classes, rest)) / letters**2).otherwise(rate)
        z_runs = (s["changes"] - (n - 1) * rate) / F.sqrt((n - 1) * rate * (1 - rate))
        z_serial = s["serial"] * F.sqrt(n)
        pairs = n * (n - 1) / 2
        k = F.lit(TEXT_COINCIDENCE)
        text_sd = F.sqrt(pairs * k * (1 - k) + n * (n - 1) * (n - 2) * (TEXT_CUBES - TEXT_COINCIDENCE**2))
        from_text = (pairs * k - (s["squares"] - n) / 2) / text_sd
        changed = (s["changes"] - (n - 1) * TEXT_CHANGES) / F.sqrt((n - 1) * TEXT_CHANGES * (1 - TEXT_CHANGES))
        ok = (F.abs(z_chi) <= MAX_Z) & (F.abs(z_runs) <= MAX_Z) & (F.abs(z_serial) <= MAX_Z)
        unlikely = (s["surprise"]["sum"] - s["surprise"]["n"] * TEXT_SURPRISE) / (TEXT_SPREAD * F.sqrt(F.greatest(s["surprise"]["n"], F.lit(1.0))))
        return F.struct(F.greatest((from_text + changed + unlikely) / F.sqrt(F.lit(3.0)), from_text, changed, unlikely).alias("z"), ok.alias("ok"))
    return let(chars, lambda c: let(stats(c, n, size), verdict))


def _cell(z: Column) -> Column:
    return F.least(F.greatest(F.floor(z * STEPS), F.lit(0)), F.lit(MOST * STEPS)).cast("int")


def _band(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(BANDS):
        out = F.when(n >= least, F.lit(i)).otherwise(out)
    return out


def limits(tested: DataFrame) -> DataFrame:
    """Per band of lengths, the least cell of z that the Benjamini-Hochberg rule accepts; from rows of ``band, cell``."""
    from pyspark.sql import Window

    cells = tested.groupBy("band", "cell").count()  # at most BANDS x (MOST x STEPS + 1) rows
    upper = Window.partitionBy("band").orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    z = F.col("cell") / F.lit(float(STEPS))
    cells = cells.withColumn("above", F.sum("count").over(upper)).withColumn("m", F.sum("count").over(Window.partitionBy("band")))
    return cells.where(F.col("m") * 4 * F.exp(-z * z / 2) / 2 <= FDR * F.col("above")).groupBy("band").agg(F.min("cell").alias("least"))


def scan(docs: DataFrame, keep=("doc_id",), text_col="text") -> DataFrame:
    """Struct ``kept`` and one array of ``s, e`` per kind, for each row of ``docs``."""
    rows = docs.select(F.struct(*map(quoted, keep)).alias("kept"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    long = lambda x, least: F.filter(x, lambda m: F.length(m["g"]) >= least)
    place = lambda x: F.transform(x, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e")))
    t = F.col("t")
    rows = rows.select("kept", place(long(found(t, ASSIGN, 2), MIN_ASSIGN)).alias("assign"), place(long(found(t, ACCESS), MIN_ACCESS)).alias("access"), place(found(t, HEX)).alias("hex"), found(t, TOKEN).alias("tokens"))
    base = rows.withColumn("base", F.concat("assign", "access", "hex"))
    free = F.filter("tokens", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    tested = F.transform(free, lambda x: let(_tested(x["g"]), lambda v: F.struct(x["s"].alias("s"), x["e"].alias("e"), _band(x["e"] - x["s"]).alias("band"), _cell(v["z"]).alias("cell"), v["ok"].alias("ok"))))
    rows = staged(base.select("kept", "assign", "access", "hex", tested.alias("tokens")))
    least = limits(rows.select(F.explode("tokens").alias("x")).select("x.band", "x.cell"))
    least = least.agg(F.map_from_entries(F.collect_list(F.struct("band", "least"))).alias("least"))  # one row, at most BANDS entries
    good = F.filter("tokens", lambda x: x["ok"] & (x["cell"] >= F.coalesce(F.try_element_at("least", x["band"]), F.lit(1 << 30))))
    return rows.join(F.broadcast(least)).select("kept", "assign", "access", "hex", place(good).alias("random"))


def _written(*kinds: str) -> Column:
    ranked = lambda i: F.transform(KINDS[i], lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))
    every = F.concat(*(ranked(KINDS.index(k)) for k in kinds))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.sort_array(every), lambda x: F.concat_ws(":", name(x["k"]), x["s"], x["e"])), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return rows.select("kept.doc_id", *counts, F.sha2(_written(*KINDS[:3]), 256).alias("base_sha256"), _written(*KINDS).alias("spans"))


SQL: dict[str, str] = {}
QUERIES = {"op1_secrets": op1_secrets}
