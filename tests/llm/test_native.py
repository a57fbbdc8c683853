"""Secrets, quality rules and mixing against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vectrail.llm import mixing, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def written(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_secrets(spark, edge_docs, no_docs):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    blob = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [
        "token=token=abcdefgh", "token=token:abcdef", "Password : 'hunter22' and api-key=x", "API_KEY=\"abc.def=\" é AKIA" + "A1" * 8, "AKIASHORT AKIA" + "Z" * 30 + "x", "0" * 23 + " " + "f" * 24 + "AbCd", "secret  =  12345 secret=123456",
        "é" * 50 + f" key {blob(48)} end", "an_ordinary_function_name_with_words somethingverylongwrittentogether", "", None, "tokenſ=abcdefgh paſſword=abcdefgh", "x" * 200_000 + " " + "deadbeef" * 5_000,
        " ".join("abcdef0123456789abcdef01" for _ in range(1200)),
    ]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = secrets.scan(docs).select("kept.doc_id", *(F.size(k).alias(k) for k in secrets.KINDS), secrets._written(*secrets.KINDS[:3]).alias("base"), secrets._written(*secrets.KINDS).alias("spans"))
    for r in found.collect():
        spans = base_spans(texts[r.doc_id] or "")
        assert r.base == written(spans) and [r[k] for k in secrets.KINDS[:3]] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert r.random == (1 if r.doc_id == 7 else 0), texts[r.doc_id]
        if r.random:
            assert r.spans == "random:55:103"
    assert secrets.scan(edge_docs).count() == edge_docs.count() and secrets.scan(no_docs).count() == 0


def test_secrets_query_against_brute_force(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = secrets.op1_secrets(spark, data).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.base_sha256 == hashlib.sha256(written(base_spans(texts[r.doc_id])).encode()).hexdigest()


def measure(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, edge_docs, no_docs):
    texts = [r.text for r in edge_docs.collect()] + ["a b c a b c", "a a a a", "x\ny\nx\n\n \n#| x", "one", "a b", "a b c"] + [" ".join(random.Random(i).choices("abcde", k=60)) for i in range(20)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.judged(docs).select("kept.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect():
        wanted = measure(texts[r.doc_id])
        assert tuple(r)[1:6] == wanted
        assert r.base_failed == (wanted[0] < 50 or 100 * wanted[4] > 50 * wanted[0])
    assert quality.judged(edge_docs).count() == edge_docs.count() and quality.passing(no_docs).count() == 0
    kept = quality.passing(edge_docs)
    assert kept.columns == edge_docs.columns


def test_quality_keeps_clean_and_rejects_odd(spark, data):
    rows = quality.op3_quality(spark, data.replace("sf0.001", "sf0.01")).join(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/labels.parquet"), "doc_id").where("not base_failed")
    clean, odd = rows.where("quality = 1"), rows.where("quality = 0")
    assert clean.where("kept").count() == clean.count()
    assert odd.where("kept").count() < 0.25 * odd.count()


def test_mixing(spark, data, edge_docs, no_docs):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = mixing.systematic_mix(docs, keep=["doc_id", "source"]).select("kept.*", "size", "source_size", "target", "copies").collect()
    assert len(rows) == docs.count() and all(0 <= r.copies <= 2 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert math.isclose(sum(v[0].target for v in by.values()), 1.5 * sum(r.size for r in rows), rel_tol=1e-9)
    for found in by.values():
        assert found[0].source_size == sum(r.size for r in found) and found[0].target <= 2 * found[0].source_size + 1e-6
        assert abs(sum(r.copies * r.size for r in found) - found[0].target) <= 2 * max(r.size for r in found)
        assert abs(sum(r.copies for r in found) - len(found) * found[0].target / found[0].source_size) < 1
    assert mixing.emitted(docs).count() == sum(r.copies for r in rows)
    again = mixing.systematic_mix(docs.repartition(7), keep=["doc_id", "source"]).select("kept.*", "size", "source_size", "target", "copies").collect()
    assert sorted(again) == sorted(rows)
    assert mixing.systematic_mix(edge_docs).count() == edge_docs.count() and mixing.systematic_mix(no_docs).count() == 0
    assert mixing.emitted(edge_docs).columns == edge_docs.columns


def test_mixing_targets_stop_at_the_cap(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), (None, 0), ("c", 500)], "source string, size long")
    found = {r.source: r for r in mixing.targets(rows).collect()}
    assert found["a"].target == 20.0 and found[None].target == 0.0 and found[None]["rank"] == 4
    # weights 3, 1, 2 in code point order; a and then c are full, b takes the rest
    assert found["c"].target == 1000.0 and found["b"].target == pytest.approx(1.5 * 1510 - 1020)


def test_secrets_of_every_encoding(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = ["0123456789ABCDEF", letters.upper() + "234567", letters + "234567", "0123456789" + letters, "0123456789" + letters.upper(), letters + letters.upper(),
                 "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", "0123456789" + letters + letters.upper(), "0123456789" + letters + letters.upper() + "+/"]
    rng = random.Random(3)
    rows = [(k, n, f"see {''.join(rng.choice(a) for _ in range(n))} for more") for k, a in enumerate(alphabets) for n in (40, 64) for _ in range(40)]
    words = "someVeryLongCamelCaseIdentifierName internationalization_of_all_things this-is-a-long-slug-for-a-page-title /usr/local/share/applications/whatever"
    found = secrets.scan(spark.createDataFrame([*rows, (99, 0, words)], "k int, n int, text string"), keep=("k", "n"))
    share = {(r.k, r.n): r.share for r in found.groupBy("kept.k", "kept.n").agg(F.avg((F.size("random") > 0).cast("int")).alias("share")).collect()}
    assert share.pop((99, 0)) == 0
    assert all(x >= (0.7 if k == 0 and n == 40 else 0.9) for (k, n), x in share.items()), share  # a short hexadecimal run is the hardest


def test_secrets_end_at_equals_and_path(spark):
    secret = "CoxkrS6Cqs4KvgCgPHxRx8ygRl4mla0wDeZEEWLR"
    text = f"x https://example.com/path/to/thing/{secret} client_key_for_upload={secret}"
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [text[x.s:x.e] for x in row.random] == [secret, secret]
