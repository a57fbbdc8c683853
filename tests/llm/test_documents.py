"""Extraction, archives, neighbours, suffixes, near duplicates, lines, packing and the pipeline against brute force."""

import base64
import collections
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vectrail.llm import components, extract, lines, near_duplicates, neighbours, packing, shingles, suffixes, warc
from vectrail.llm.common import shared_dir, word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def family(n_docs=60, n_words=60, seed=3):
    """Copies of a text with more and more edits, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(n_words)]
    out = []
    for i in range(n_docs):
        text = list(base)
        for _ in range(i % 7):
            text[rng.randrange(len(text))] = word()
        out.append(" ".join(text) if i % 5 else " ".join(word() for _ in range(n_words)))
    return out


# pages
PAGE = """<html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><header><a href=/>Home</a> <a href=/x>All</a></header>
<nav><ul><li><a href=/a>A</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site, please agree to all of them now.</p></div>
<article><header><h1>Head &amp; tail</h1></header><p>First&nbsp;paragraph   with <b>bold
text.<br><p>Short.</p><div class="ad">Buy now!</div><ul><li>one<li>two</ul><div id="comments"><p>I am a reader, and this is my long comment on the article.</p></div><p>2 &lt; 3 &#8212; end.</p></article>
<aside class=sidebar><p>Something on the side that is rather long, too.</p></aside><form><label>Mail</label><input></form><footer>&copy; 2024</footer>"""


def test_main_text():
    assert extract.main_text(PAGE) == "Head & tail\nFirst paragraph with bold text.\nShort.\none\ntwo\n2 < 3 — end."
    assert [extract.main_text(x) for x in (None, "", "<script>x", "<!-- x", "<p></p>")] == [""] * 5
    assert extract.main_text("<div class=post><p>" + "word " * 50_000 + "<p>x</div>").count("word") == 50_000
    assert extract.main_text("</div></p><article><p>a</b></i>b</article></article>") == "ab"


def test_only_script_style_and_comments_swallow_the_rest():
    for inside in ('<svg-icon name="x"></svg-icon>', "<svg/>", "<button-group></button-group>", "<object-x/>", "<template-x>", "<svg>", "<select>", "<svg><path/></svg>", "<script-x></script-x>"):
        assert extract.main_text(f"<article>{inside}<p>text</p></article>") == "text", inside
    for name in ("math", "object", "noscript"):
        assert extract.main_text(f"<article><p>one <{name}>two</{name}> three</p></article>") == "one two three"
    assert extract.main_text("<article><p>a</p>" + "<svg>" * 50_000 + "<p>b</p></article>") == "a\nb"
    assert extract.main_text("<article><p>a</p><style>b<p>c</p>") == "a"


def test_min_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 7)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda labels: sum(max(0, s) if not x else max(0, -s) for s, x in zip(scores, labels)) + sum(w for a, b, w in edges if labels[a] != labels[b])  # noqa: B023, E731
        least = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(extract.min_cut(scores, edges)) == pytest.approx(least)


def test_extract_query(spark, data):
    found = {r.page_id: r for r in extract.op2_extract(spark, data).collect()}
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        inner = p.html[p.html.index("<article>") + 9 : p.html.rindex("</article>")]
        blocks = [" ".join(extract.entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert found[p.page_id].text == "\n".join(b for b in blocks if b) and found[p.page_id].n_chars == len(found[p.page_id].text)
    assert extract.extracted(spark.createDataFrame([(1, None, None, "x")], "page_id long, url string, html string, text string")).first().text == ""


# archives
def test_bundles_are_seekable(tmp_path):
    bundle = warc.Bundle()
    payloads = [f"<p>{i}</p>".encode() * (i + 1) for i in range(200)]
    for i, p in enumerate(payloads):
        bundle.add(i, warc.record(i, f"http://x/{i}", p, len(p), warc.base32_sha1(p)))
    path = tmp_path / "b.warc.zst"
    path.write_bytes(bundle.finish())
    reader = warc.open_bundle(str(path))
    assert len(reader.sizes) == 4
    for i in (0, 63, 64, 199):
        _, frame, offset, _ = bundle.where[i]
        headers, payload = reader.record(frame, offset)
        assert payload == payloads[i] and headers["WARC-Record-ID"] == f"<urn:page:{i}>"
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 200
    with pytest.raises(ValueError):
        warc.parse(b"x\r\n\r\n")


def test_archive(spark, tmp_path):
    rows = [(1, "u", "same"), (2, "u", "same"), (5, None, "same"), (5, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (None, "u", "own"), (7, "a\nb", "é" * 300_000)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, size int, digest string")
    folder = f"{shared_dir(spark)}/test-warc-{tmp_path.name}"
    found = sorted(((r.page_id, r.record_type, r.refers_to, r.stated_bytes, r.stated_digest) for r in warc.read_bundles(warc.archived(pages, folder)).collect()), key=str)
    last = {"same": 5, "": 4, "own": None, "é" * 300_000: 7}
    wanted = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = last[html or ""]
        revisit = i != to
        wanted.append((i, "revisit" if revisit else "response", to if revisit else None, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()))
    assert found == sorted(wanted, key=str)
    assert {r.record_type for r in warc.read_bundles(warc.archived(pages, folder + "b", least=10**9)).collect()} == {"response"}
    assert warc.read_bundles(warc.archived(pages.where("1 = 0"), folder + "c")).count() == 0


# neighbours
def test_neighbours(spark, data):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 8)).astype(np.float32).tolist()
    vectors[10] = vectors[20] = vectors[30] = vectors[0]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(0, vectors[0]), (1000, None), (1050, [0.0] * 8), (1100, [float("nan")] * 8), (1150, [1.0] * 7 + [None]), (1200, [1.0, 2.0]), (1201, [2.0, 1.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    table = table.where(F.col("vec_id").isNotNull() & neighbours.usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    found = collections.defaultdict(list)
    for r in neighbours.search(table, table.where("vec_id % 50 = 0"), k=5, stop=0.99).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    x = np.array(vectors)
    hits = 0
    for q in range(0, 400, 50):
        score = x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
        score[q] = -9
        best = np.lexsort((np.arange(400), -np.round(score, 12)))[:5]
        hits += sum(a == b and abs(s - score[b]) < 1e-12 for (a, s), b in zip(found[q], best, strict=True))
    assert hits >= 0.9 * 40
    assert [i for i, _ in found[0][:3]] == [10, 20, 30]
    assert [i for i, _ in found[1200]] == [1201] and set(found) == {*range(0, 400, 50), 1200}
    assert neighbours.search(table.limit(0), table.limit(0)).count() == 0
    t = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    x = np.array(t.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    right = total = 0
    for r in neighbours.op4_neighbours(spark, data).collect():
        score = x @ x[t.index[t.vec_id == r.query_id][0]]
        total += 1
        right += (score > r.score + 1e-9).sum() <= r["rank"]
    assert right >= 0.9 * total and total == 5 * (t.vec_id % 50 == 0).sum()


def test_repeated_rows_and_ids_with_several_vectors_hide_none(spark):
    rng = np.random.default_rng(14)
    same, six = [1.0, 0.5, 0.0], [0.0, 1.0, 0.5]
    rows = [(0, same)] * 2 + [(i, same) for i in (10, 20, 30, 40, 50)] + [(60, six)] * 6 + [(i, six) for i in (70, 80, 90, 95, 97)]
    rows += [(100, [-1.0, 0.001 * i, 0.0]) for i in range(9)] + [(i, [-1.0, *rng.uniform(0.1, 0.3, 2).tolist()]) for i in range(101, 120)]
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    found = collections.defaultdict(list)
    for r in neighbours.search(table, table.where("vec_id in (0, 60, 100)"), stop=1.0).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    x = {i: [np.array(v) for j, v in rows if j == i] for i, _ in rows}
    cosine = lambda a, b: max(u @ v / np.linalg.norm(u) / np.linalg.norm(v) for u in x[a] for v in x[b])
    for q in (0, 60, 100):
        assert found[q] == sorted((i for i in x if i != q), key=lambda i: (-round(cosine(q, i), 12), i))[:5]  # noqa: B023


def test_chi_square():
    rng = np.random.default_rng(0)
    sample = (rng.normal(size=(200_000, neighbours.PROJECTED)) ** 2).sum(1)
    for x in (2.0, 8.0, 15.0):
        assert neighbours.chi_square(np.array([x]))[0] == pytest.approx((sample <= x).mean(), abs=0.01)


# suffixes
def removed(rows):
    seen, out = collections.defaultdict(lambda: None), []
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                seen[w] = i if seen[w] is None else min(seen[w], i)
    for i, t in rows:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and seen[b[p : p + 50]] is not None and seen[b[p : p + 50]] < i:
                mask[p : p + 50] = b"\1" * 50
        out.append((i, len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(bytes(c for c, m in zip(b, mask) if not m)).hexdigest()))
    return sorted(out, key=str)


def test_suffixes(spark, edge_docs, no_docs, monkeypatch):
    rng = random.Random(8)
    passage = "".join(rng.choice("abc ") for _ in range(120))
    rows = [(i, "".join(rng.choice("abcdefg ") for _ in range(rng.randint(0, 300))) + passage[rng.randint(0, 70) :] + "é" * rng.randint(0, 30)) for i in range(40)]
    rows += [(41, "a" * 500), (42, "b" + "a" * 60), (42, "a" * 49), (43, "a" * 50), (None, "a" * 80), (44, None), (45, "")]
    for shard in (suffixes.SHARD_BYTES, 2000):
        monkeypatch.setattr(suffixes, "SHARD_BYTES", shard)
        docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_bytes int, chunk string").repartition(3)
        found = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated(docs).collect()), key=str)
        assert found == removed(rows)
    edges = [(r.doc_id, r.text if r.text is None or len(r.text) < 5000 else r.text) for r in edge_docs.collect()]
    found = suffixes.repeated(edge_docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=str) == removed(edges)
    assert suffixes.repeated(no_docs).count() == 0


def test_shard_merging():
    rng = random.Random(1)
    base = bytes(rng.choice(b"ab") for _ in range(400))
    for _ in range(20):
        snippets = [x for x in {base[a : a + rng.randint(50, 84)] for a in [rng.randint(0, 300) for _ in range(60)]} if len(x) >= 50]
        ids = np.array([rng.randint(0, 50) for _ in snippets])
        least = {}
        for x, i in zip(snippets, ids.tolist()):
            for p in range(len(x) - 49):
                least[x[p : p + 50]] = min(least.get(x[p : p + 50], 99), i)
        for size in (10**9, 500):
            _, found = suffixes.smallest_ids(snippets, ids, size)
            assert found.tolist() == [least[x[p : p + 50]] for x in snippets for p in range(len(x) - 49)]


# near duplicates
def sets_of(rows, k):
    out = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append(frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def groups(n, links):
    parent = list(range(n))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, edge_docs, k, percent):
    rows = [(i, t) for i, t in enumerate(family())] + [(100 + i, r.text) for i, r in enumerate(edge_docs.collect())]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component string, n int").repartition(3)
    sets = sets_of(rows, k)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    group = groups(len(rows), links)
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}
    found = {r.doc_id: r for r in near_duplicates.near_duplicates(docs, k, percent).collect()}
    assert {i: (found[i].n, found[i].component_id) for i, _ in rows} == {i: (len(sets[x]), least[group[x]]) for x, (i, _) in enumerate(rows)}
    kept = near_duplicates.representatives(docs, k, percent)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_near_duplicates_edges(spark, edge_docs, no_docs):
    rows = near_duplicates.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {(r.doc_id, r.n): r.component_id for r in rows}
    assert {c for (i, n), c in by.items() if i in (1, 2, 3)} == {1} and {c for (i, n), c in by.items() if not n} == {4, 5, 6, None}
    assert near_duplicates.near_duplicates(no_docs).count() == 0 and near_duplicates.representatives(no_docs).count() == 0
    ids = [r.doc_id for r in near_duplicates.representatives(edge_docs).collect()]
    assert ids.count(2) == 0 and ids.count(1) == 1 and {4, 5, 6} <= set(ids)


def test_near_duplicates_after_candidates_read_only_documents_that_meet(spark, monkeypatch):
    """A pair, sets and representatives must cost no work on documents that meet no other, nor a loop of jobs for few links."""
    rng = random.Random(8)
    alone = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate([*alone, alone[0] + " x", alone[1]]), (99, None), (98, " ")], "doc_id long, text string")
    seen, rounds = [], []
    likely, staged = near_duplicates.likely, components.staged
    monkeypatch.setattr(near_duplicates, "likely", lambda pairs, nodes, percent: seen.append(nodes.count()) or likely(pairs, nodes, percent))
    monkeypatch.setattr(components, "staged", lambda df: rounds.append(df) or staged(df))
    kept = near_duplicates.representatives(docs, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(40), 98, 99]
    assert seen == [2, 2, 2] and len(rounds) == 6
    assert "regexp_count" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_registers_estimate_similarity():
    rng = np.random.default_rng(6)
    for shared in (300, 700, 900):
        both = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
        a, b = (np.sort(np.concatenate([both, rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64)])) for _ in range(2))
        u, v = near_duplicates.registers([a]), near_duplicates.registers([b])
        j, _ = near_duplicates.estimate(u, v, np.array([1000.0]), np.array([1000.0]), 0.8)
        assert abs(j[0] - shared / (2000 - shared)) < 0.2
        union = near_duplicates.registers([np.union1d(a, b)])
        assert (union == np.maximum(u, v)).all()
        apart = np.bitwise_count((near_duplicates.parities([a]) ^ near_duplicates.parities([b])).view(np.uint64)).sum()
        assert apart <= 2 * (1000 - shared)


def test_words_across_segments(monkeypatch):
    text = " ".join(family()).encode() + b"\n"
    whole = shingles.words_of(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(shingles, "SEGMENT", 37)
    monkeypatch.setattr(shingles, "_POWERS", [])
    parts = shingles.words_of(np.frombuffer(text, np.uint8))
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0]) == len(text.split())


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_by_driver_and_by_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    rng = random.Random(few)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(50)] + [(7, 7), (-5, 1 << 62)]
    names = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(names)}
    group = groups(len(names), [(at[a], at[b]) for a, b in edges if a != b])
    least = {g: min(names[i] for i in range(len(names)) if group[i] == g) for g in set(group)}
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in found) == [(x, least[group[i]]) for i, x in enumerate(names)]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = groups(600, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: min(y for y in linked if group[y] == group[x]) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# lines
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_edits_by_arrays_are_those_of_pairs():
    rng = np.random.default_rng(7)
    left, right = [], []
    for n in (1, 4, 5, 12, 63, 64, 65, 128, 130, 300, 600):
        for _ in range(25):
            a = [f"w{i}" for i in rng.integers(0, 30, n)]
            b = list(a)
            for _ in range(rng.integers(0, n // 3 + 2)):
                at = int(rng.integers(0, len(b)))
                b[at : at + int(rng.integers(0, 2))] = [f"v{i}" for i in range(int(rng.integers(0, 2)) or int(len(b) == 1))]
            left.append(" ".join(a))
            right.append(" ".join(b))
    found = lines.similar_rows(pa.array(left), pa.array(right))
    assert found.tolist() == [lines.similar(a.split(" "), b.split(" ")) for a, b in zip(left, right, strict=True)]
    assert 0 < found.sum() < len(found) and len(lines.similar_rows(pa.array([], pa.string()), pa.array([], pa.string()))) == 0


def test_simhash_is_the_majority_of_each_bit():
    rng = np.random.default_rng(8)
    size = np.array([1, 0, 2, 255, 256, 700, 3])
    hashes = rng.integers(0, 1 << 64, size.sum(), dtype=np.uint64)
    last = np.cumsum(size)
    found = lines.simhash(hashes, last - size, last)
    for i, (a, b) in enumerate(zip(last - size, last, strict=True)):
        words = [int(x) for x in hashes[a:b]]
        assert int(found[i]) == sum(1 << bit for bit in range(64) if 2 * sum(w >> bit & 1 for w in words) > len(words))


def test_edit_distance():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert lines.edit_distance(a, b) == distance(a, b)


def test_lines(spark, edge_docs):
    texts = family(40, 30)
    rows = [(i, "\n".join([texts[i], texts[(i * 3) % 40], "a b", "", "| | | | | | x"])) for i in range(40)] + [(200 + i, r.text) for i, r in enumerate(edge_docs.collect())]
    places = collections.OrderedDict()
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            w = tuple(WORD.findall(line.translate(LOWER)))
            if len(w) >= lines.MIN_WORDS:
                places.setdefault(w, []).append((i, n))
    kinds = list(places)
    links = [(i, j) for i in range(len(kinds)) for j in range(i) if lines.similar(list(kinds[i]), list(kinds[j]))]  # every pair; its distance is tested above
    group = groups(len(kinds), links)
    first = {g: min(p for k, x in enumerate(kinds) if group[k] == g for p in places[x]) for g in set(group)}
    gone = {p for k, x in enumerate(kinds) for p in places[x] if p != first[group[k]]}
    docs = spark.createDataFrame([(i, t, "odd", 1) for i, t in rows], "doc_id long, text string, th string, line int").repartition(3)
    found = {r.doc_id: r.text for r in lines.deduplicated(docs).select("kept.doc_id", "text").collect()}
    assert found == {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}
    assert lines.thinned(docs).columns == docs.columns


@pytest.mark.parametrize("few", [2, 64])
def test_lines_of_a_key_meet(monkeypatch, few):
    """Every two lines with a common key are a pair, or entries of that key that are connected by its ends."""
    monkeypatch.setattr(lines, "FEW", few)
    rng = np.random.default_rng(4)
    parts = [(rng.integers(0, 40, 300).astype(np.uint64) << np.uint64(16) | np.uint64(30 << 8 | lines.ANYWHERE), rng.integers(1, 60, 300).astype(np.uint64)) for _ in range(3)]
    parts = [tuple(x[np.unique(np.stack(p), axis=1, return_index=True)[1]] for x in p) for p in parts]
    sent = pa.concat_tables([pa.Table.from_batches([lines._bundled(*p, 1)]) for p in parts])
    hot = [sent.filter(pa.compute.equal(sent["bucket"], b)) for b in set(sent["bucket"].to_pylist())]
    rows = [r for x in hot for r in lines._met(x).to_pylist()]
    pairs = {frozenset((r["lo"], r["hi"])) for r in rows if r["key"] is None}
    members = collections.defaultdict(set)
    for keys, h1 in parts:
        for k, x in zip((keys >> np.uint64(16)).tolist(), h1.tolist(), strict=True):
            members[k].add(x)
    for k, found in members.items():
        own = [r for r in rows if r["key"] == k]
        if own:
            ends = [(r["h1"], r[e]) for r in own for e in ("lo", "hi")]
            assert {r["h1"] for r in own} == found and len(set(np.array(groups(60, ends))[list(found)])) == 1
        else:
            assert all(frozenset((a, b)) in pairs for a in found for b in found if a != b)
    assert bool(pairs) == (few == 64) or few == 2


def test_lines_pairs_travel_packed():
    """Direct pairs come as packed bytes, not as a row each; those that come up twice are found, whatever their order."""
    rng = np.random.default_rng(6)
    pairs = np.unique(rng.integers(1, 1 << 62, (3000, 2)), axis=0)
    often = np.concatenate([pairs, pairs[:700], pairs[:90]])[rng.permutation(3790)]
    met = pa.table({"key": pa.nulls(3790, pa.int64()), "h1": pa.nulls(3790, pa.int64()), "lo": often[:, 0], "hi": often[:, 1]})
    parts = [lines._packed(met.slice(a, 1000), 8) for a in range(0, 3790, 1000)]
    assert max(len(p) for p in parts) <= 8
    every = pa.concat_tables(parts)
    found = [lines._twice(every.filter(pa.compute.equal(every["at"], i))) for i in range(8)]
    assert sorted((r["a"], r["b"]) for t in found for r in t.to_pylist()) == sorted(map(tuple, pairs[:700].tolist()))


def test_lines_near_keys():
    """Keys at places that edits explain are near; places that differ in front and, the other way, behind are not."""
    key = lambda n, at: np.array([int(lines.length_code(np.array([n]))[0]) << 8 | at], np.uint64)
    rng = np.random.default_rng(7)
    for _ in range(500):
        n = int(rng.integers(4, 240))
        d = (100 - lines.PERCENT) * n // 100
        before, behind = sorted(rng.integers(0, d + 1, 2))
        at = int(rng.integers(0, n - 1))
        lost = min(int(before), at), min(int(behind - before), n - 2 - at)  # words dropped in front and behind
        assert lines._near(key(n, at), key(n - sum(lost), at - lost[0]))[0]
    assert not lines._near(key(100, 50), key(100, 35))[0]  # 15 edits in front and 15 behind
    assert lines._near(key(100, 50), key(100, lines.ANYWHERE))[0] and not lines._near(key(100, 50), key(60, lines.ANYWHERE))[0]


def test_lines_edges(spark, edge_docs, no_docs):
    found = lines.deduplicated(edge_docs)
    assert found.count() == edge_docs.count() and lines.deduplicated(no_docs).count() == 0
    twice = found.where("kept.doc_id = 2").collect()
    assert len(twice) == 2 and all(r.n_removed == 1 and r.text == "" for r in twice)  # document 1 has the line


def test_short_lines_are_removed_if_equal(spark):
    docs = spark.createDataFrame([(1, "All rights reserved.\nhome\na b c d"), (2, "all  rights reserved.\n\nHOME\na b c e"), (3, "x\n \nhome\nall rights")], "doc_id long, text string")
    found = {r.doc_id: (r.text, r.n_removed) for r in lines.deduplicated(docs).select("kept.doc_id", "text", "n_removed").collect()}
    assert found == {1: ("All rights reserved.\nhome\na b c d", 0), 2: ("\na b c e", 2), 3: ("x\n \nall rights", 1)}


def test_lines_link_at_any_simhash_distance(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for n in (5, 6, 8, 9, 10, 12, 15, 20, 25, 31, 50, 104):
        for _ in range(4):
            base = [word() for _ in range(n)]
            rows.append(" ".join(base))
            for edits in (n // 5, n // 5 + 1):
                text = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(text))
                    text[at : at + 1] = rng.choice([[word()], [word(), text[at]], []])
                rows.append(" ".join(text))
    rows.append("a a a a a a a a b a")
    rows.append("a a a a a a a a a a a")
    kinds = [x.split() for x in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * (max(len(kinds[i]), len(kinds[j])) - distance(kinds[i], kinds[j])) >= 80 * max(len(kinds[i]), len(kinds[j]))]
    group = groups(len(rows), [(i, j) for i, j in links if min(len(kinds[i]), len(kinds[j])) >= lines.MIN_WORDS])
    assert len(links) > 48
    first = {g: min(i for i in range(len(rows)) if group[i] == g) for g in set(group)}
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    found = {r.doc_id for r in lines.deduplicated(docs).where("n_removed = 0").select("kept.doc_id").collect()}
    assert found == set(first.values())



def test_lines_of_frequent_keys_meet_in_arrays(spark, monkeypatch):
    """Each pair within the bound comes up, also where a key's lines are dealt into parts; else its key is named and the rest follows."""
    rng = np.random.default_rng(5)
    texts = [[f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(8, 40)))] for _ in range(12)]
    texts = [" ".join(t[:i] + ["new"] + t[i + 1 :]) for t in texts for i in (0, 1, 2, 3, 5, 7)]
    made = lines.occurrences(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).where("words is null")
    made = lines.staged(made.select(F.col("doc_id").alias("id"), "h1", F.col("n").alias("words"), "doc_id", "th", "at", "bytes", "sim", *lines.ODD))
    shown = lines.staged(made.select((F.col("id") % 2).alias("key"), "h1").union(made.select(F.lit(7), "h1").where("id < 30")))
    sizes = shown.groupBy("key").count()
    rows = {r.id: r for r in made.collect()}
    def near(x, y):
        apart = sum(((int(x[o]) ^ int(y[o])) & (1 << 64) - 1).bit_count() for o in lines.ODD)
        long = max(x.words, y.words)
        return 100 * min(x.words, y.words) >= lines.PERCENT * long and 100 * (apart + abs(x.words - y.words)) <= 2 * (100 - lines.PERCENT) * long
    want = {(a, b) for a in rows for b in rows if a < b and (a % 2 == b % 2 or b < 30) and near(rows[a], rows[b])}
    assert len(want) > 50
    own = spark.createDataFrame([(i, i) for i in rows], "node long, component long")
    for cell in (1 << 13, 8):
        monkeypatch.setattr(lines, "MOST_CELL", cell)
        found = lines._meeting(shown, sizes, made, None).collect()
        assert {(r.a, r.b) for r in found if r.key is None} == want and not [r for r in found if r.key is not None]
        monkeypatch.setattr(lines, "MOST_FIRST", 1)
        found = lines._meeting(shown, sizes, made, None).collect()
        few, dense = {(r.a, r.b) for r in found if r.key is None}, {r.key for r in found if r.key is not None}
        assert few < want and dense
        rest = {(r.a, r.b) for r in lines._meeting(shown.where(F.col("key").isin(*dense)), sizes, made, own).collect()}
        assert few | rest == want
        monkeypatch.setattr(lines, "MOST_FIRST", 16)


def test_staged_frames_send_few_rows_to_python_at_once(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = [r.n for r in lines.staged(spark.range(0, 9000, 1, 1).mapInArrow(run, "n long")).collect()]
    assert sum(sizes) == 9000 and max(sizes) <= 2048
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_lines_of_dense_keys_meet_without_their_entries(spark, monkeypatch):
    """What is left of a key after each line met a few others comes up from the packed lines, as it does by the entries."""
    rng = np.random.default_rng(6)
    texts = [[f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(8, 40)))] for _ in range(8)]
    texts = [" ".join(t[:i] + ["new"] + t[i + 1 :]) for t in texts for i in (0, 1, 2, 3, 5, 7)]
    made = lines.occurrences(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).where("words is null")
    made = lines.staged(made.select(F.col("doc_id").alias("id"), "h1", F.col("n").alias("words"), *lines.ODD))
    shown = lines.staged(made.select((F.col("id") % 2).alias("key"), "h1"))
    sizes = shown.groupBy("key").count()
    own = spark.createDataFrame([(i, i - i % 3) for i in range(0, len(texts), 2)], "node long, component long")
    monkeypatch.setattr(lines, "MOST_FIRST", 1)
    for cell in (1 << 13, 8):
        monkeypatch.setattr(lines, "MOST_CELL", cell)
        first = lines.staged(lines._meeting(shown, sizes, made, None))
        dense = first.where("key is not null")
        some = {(r.a, r.b) for r in first.where("key is null").collect()}
        want = {(r.a, r.b) for r in lines._meeting(shown, sizes, made, own).collect()}
        found = {(r.a, r.b) for r in lines._apart(dense.select("cell"), own).collect()}
        assert found <= want <= found | some and (found - some or cell == 8)


def test_lines_of_dense_keys_leave_links_instead_of_pairs(spark, monkeypatch):
    """Each two of 60 lines are within the bound and unlinked but for few, and share three keys: what leaves a task are links, not pairs."""
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in range(30)]
    texts = [" ".join(np.array(base)[rng.permutation(30)]) for _ in range(45)]  # equal words, far apart
    texts += [" ".join([f"v{i}", *t.split(" ")[1:]]) for i, t in enumerate(texts[:15])]
    texts += [f"u{i} " + " ".join(f"z{j}" for j in range(520)) for i in range(3)]  # long ones
    made = lines.occurrences(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).where("words is null")
    made = lines.staged(made.select(F.col("doc_id").alias("id"), "h1", F.col("n").alias("words"), *lines.ODD))
    shown = lines.staged(made.select(F.explode(F.expr("array(1L, 2L, 3L)")).alias("key"), "h1"))
    sizes = shown.groupBy("key").count()
    words = spark.createDataFrame(list(enumerate(texts)), "id long, words string")
    found = spark.createDataFrame([(0, 0), (45, 0)], "node long, component long")
    monkeypatch.setattr(lines, "MOST_FIRST", 1)
    want = {(a, b) for b in range(len(texts)) for a in range(b) if lines.similar(texts[a].split(), texts[b].split())}
    assert len(want) > 15
    for cell, room in ((1 << 13, 1 << 18), (8, 40)):
        monkeypatch.setattr(lines, "MOST_CELL", cell)
        monkeypatch.setattr(lines, "ROOM_LINES", room)
        dense = lines.staged(lines._meeting(shown, sizes, made, None)).where("key is not null")
        assert len({(r.a, r.b) for r in lines._meeting(shown, sizes, made, found).collect()}) > 900
        for rooms in (lines._apart(dense.select("cell"), found, True), lines._meeting(shown, sizes, made, found, True)):
            rooms = lines.staged(rooms)
            links = [(r.a, r.b) for r in lines._linked(rooms, words).collect()]
            assert len(links) < len(texts) * rooms.count() and set(links) <= want
            if cell > len(texts):
                one, other = (groups(len(texts), [*x, (0, 45)]) for x in (links, want))
                assert len({*zip(one, other, strict=True)}) == len({*one}) == len({*other})


def test_lines_removed_by_bytes(spark):
    texts = ["ä b c d e\n\nx ü z v w\n", "x ü z v w\n", "\n ä b c d e\nnur hier, ganz allein jetzt", "x ü z v w", "x ü z v w\n\n", "ä b c d e\nund hier noch eine davon\nä b c d e", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.deduplicated(docs).select("kept.doc_id", "text", "n_lines", "n_removed").collect()}
    assert found == {0: (texts[0], 4, 0), 1: ("", 2, 1), 2: ("\nnur hier, ganz allein jetzt", 3, 1), 3: ("", 1, 1), 4: ("\n", 3, 1), 5: ("und hier noch eine davon", 3, 2), 6: (None, 0, 0)}


def test_lines_edits_at_most():
    """The quick bound is never below the distance, and tells a line with one word dropped or some replaced."""
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randint(1, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.randrange(4)][: rng.randint(0, 1)]
        pairs.append((a, b or [0]))
    texts = [t for p in pairs for t in p]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x = np.arange(0, len(texts), 2)
    found = lines.at_most(np.concatenate(texts).astype(np.int32), begin, x, x + 1).tolist()
    assert all(f >= distance(a, b) for f, (a, b) in zip(found, pairs, strict=True))
    assert sum(f == distance(a, b) for f, (a, b) in zip(found, pairs, strict=True)) > 150
    words = np.array([1, 2, 3, 4, 5, 1, 2, 4, 5, 9, 2, 8, 4, 5], np.int32)
    assert lines.at_most(words, np.array([0, 5, 9, 14]), np.array([0, 0]), np.array([1, 2])).tolist() == [1, 2]


def test_lines_know_their_bytes(spark):
    text = "één, zwei\n\n  drei vier \nfünf"
    rows = lines.occurrences(spark.createDataFrame([(1, text), (2, None), (3, "x\n" + text)], "doc_id long, text string")).where("words is null").collect()
    source = {1: text, 3: "x\n" + text}
    assert len(rows) == 7 and all(source[r.doc_id].encode()[r["at"] : r["at"] + r["bytes"]].decode() == source[r.doc_id].split("\n")[r.line] for r in rows)


# packing
def test_best_fit():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    where, bins = packing.cheapest(sizes, (25, 50, 100), 2)
    used = collections.Counter()
    for n, b in zip(sizes, where, strict=True):
        used[b] += n
    assert all(used[b] <= c and c == min(x for x in (25, 50, 100) if x >= used[b]) for b, c in enumerate(bins))
    assert sum(bins) < 1.1 * sum(sizes)
    cost = lambda x: sum(x[1]) + 2 * len(x[1])
    assert cost((where, bins)) == min(cost(packing.best_fit(sizes, (25, 50, 100), o)) for o in (None, 25, 50, 100))


def test_packing(spark, data, edge_docs, no_docs):
    for docs in (spark.read.parquet(f"{data}/documents.parquet"), edge_docs):
        rows = packing.packed(docs).collect()
        sizes = collections.Counter((r.doc_id, r.n) for r in docs.select("doc_id", word_count(F.col("text")).alias("n")).collect())
        pieces = collections.defaultdict(list)
        for r in rows:
            pieces[r.doc_id, r.copy].append((r.start, r.length))
        assert all([s for s, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))] for key, p in pieces.items() if len({n for (d, n), c in sizes.items() if d == key[0]}) == 1)
        assert sum(r.length for r in rows) == sum(n * c for (_, n), c in sizes.items())
        bins = collections.defaultdict(list)
        for r in rows:
            if r.length:
                bins[r.bin].append(r)
            else:
                assert r.bin is None
        for found in bins.values():
            found.sort(key=lambda r: r.offset)
            assert [r.offset for r in found] == [sum(x.length for x in found[:i]) for i in range(len(found))]
            assert {r.filled for r in found} == {sum(r.length for r in found)} and found[0].filled <= found[0].capacity in packing.CAPACITIES
    assert packing.packed(no_docs).count() == 0
    assert sorted(packing.packed(edge_docs.repartition(5)).collect(), key=str) == sorted(packing.packed(edge_docs).collect(), key=str)


# pipeline
def test_pipeline(spark, data):
    from vectrail.llm.common import staged
    from vectrail.llm.quality import op3_quality

    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mix", "sequence_packing"]
    kept, last = docs, None
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, staged(stage(spark, kept, data))
        if name != "sequence_packing":
            assert kept.columns == docs.columns
        if name == "quality_rules":
            assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in op3_quality(spark, data).where("kept").collect())
        if name == "line_dedup":
            assert kept.where("n_chars <> length(text)").count() == 0 and 0 < kept.count() <= before.count()
        if name == "near_dedup":
            groups_of = near_duplicates.near_duplicates(before, 5, 80).collect()
            assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in groups_of})
        last = before
    words = last.select(F.sum(word_count(F.col("text")))).first()[0]
    assert kept.agg(F.sum("length")).first()[0] == words
    assert sorted(corpus_pipeline.run(spark, data).collect(), key=str) == sorted(kept.collect(), key=str)


def test_extract_hostile_html():
    body = "text " * 30
    assert extract.main_text("<article><svg class=x /><p>one</p></article>") == "one"
    assert extract.main_text("<article><p data-x=it's>a b</p><p>don't</p></article>") == "a b\ndon't"
    assert extract.main_text(f"<article><div class='article-header'><h1>Title</h1></div><p>{body}</p></article>") == "Title\n" + body.strip()
    assert extract.main_text(f"<section class='ad-free content'><p>{body}</p></section>") == body.strip()
    assert extract.main_text(f"<div class='story search-result'><p>{body}</p></div>") == body.strip()
    assert extract.main_text("<article><p>one</p>two <b") == "one\ntwo <b"
    for part in ('<a "', '<a x="', "<a x='>' ", "<p "):
        begun = time.time()
        extract.main_text(part * 100_000)
        assert time.time() - begun < 5


def test_extract_repeated_rows_and_clashing_names(spark):
    rows = [(1, "u", "<article><p>a</p></article>", 5), (1, "u", "<article><p>a</p></article>", 5), (2, None, None, 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    assert sorted((r.page_id, r.text, r.n_chars) for r in extract.extracted(pages).collect()) == [(1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert extract.extracted(pages.where("1 = 0")).count() == 0


def test_bins_open_at_their_own_size():
    lengths = [700, 500, 300, 300, 200, 200, 100, 24]
    where, sizes = packing.best_fit(lengths, overhead=16)
    filled = [sum(n for n, b in zip(lengths, where) if b == i) for i in range(len(sizes))]
    assert sum(filled) == sum(lengths) and all(f <= s for f, s in zip(filled, sizes))
    rng = random.Random(2)
    for _ in range(5):
        lengths = sorted((rng.randint(1, 4096) for _ in range(300)), reverse=True)
        cost = lambda x: sum(x[1]) + 16 * len(x[1])
        assert cost(packing.cheapest(lengths)) <= min(cost(packing.best_fit(lengths, opening=o)) for o in (None, *packing.CAPACITIES))


def test_warc_paths(tmp_path):
    for uri in (f"file:{tmp_path}/a", f"file://{tmp_path}/a", f"{tmp_path}/a"):
        store, path = warc._store(uri)
        assert type(store).__name__ == "LocalFileSystem" and path == f"{tmp_path}/a"
