"""Corpus operators against brute force on the smallest tables, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assayloom.llm import ann, components, html_extract, mixing, packing, quality, secrets, simhash, token_files, tokens, toxicity, warc
from assayloom.session import stage_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, key int, v string, h string, blob string, bin int, part int, label int, row string, spans string, size int, words int"
LONG = "lorem ipsum " * 40_000


def doc(i, text, source="s"):
    return (i, text, None, source, None if text is None else len(text), 1, "x", 1, "x", "x", "x", 1, 1, 1, "x", "x", 1, 1)


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, text and source, empty and very long texts, ties, repeated rows, clashing names."""
    texts = ["one two three four five six seven eight nine ten eleven", "", " \n ", "token: abcdef0123", LONG, None, "one two three four five six seven eight nine ten eleven"]
    rows = [doc(i, t) for i, t in enumerate(texts)] + [doc(1, ""), doc(0, texts[0]), doc(None, texts[0]), doc(None, None), doc(9, "x y z", None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def query(spark, data, number):
    name = next(n for n in entry.queries() if n.startswith(f"op{number}_"))
    return entry.queries()[name](spark, data).collect()


# 1 quality rules

def test_base_counts_by_hand():
    text = "a b c d e a b c d e #x\n#x\n\n#x"
    assert quality.base_counts(text, text.encode().split()) == (13, 16, 3, 1, 10, True)
    assert quality.base_counts("", []) == (0, 0, 0, 0, 0, True)


def test_quality_on_odd_rows(odd, none):
    labels = odd.sparkSession.createDataFrame([(0, 1), (None, 1), (4, 0)], "doc_id long, quality int")
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == odd.count() and Counter(r.kept for r in rows if r.n_words < 10) == {False: 7}
    kept = quality.quality_filter(odd, labels)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == {0: 2, 6: 1, None: 1}
    assert quality.quality_scores(none, labels).count() == 0
    unlabelled = quality.quality_scores(odd, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.0}


def test_all_trusted_documents_count(spark):
    """More trusted ids than any bound: every one of their words is counted, repeated and missing ids as in the SQL."""
    n = 41_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).union(spark.createDataFrame([(0, "a b"), (None, "a b"), (n + 5, "a b")], "doc_id long, text string"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).union(spark.createDataFrame([(1, 1), (1, 0), (None, 1), (n + 5, 0)], "doc_id long, quality int"))
    seen = {}
    fit = quality.fit
    try:
        quality.fit = lambda *a: seen.update(rows=quality.gram_counts(*a).collect()) or fit(*a)
        quality.quality_scores(docs, labels)
    finally:
        quality.fit = fit
    assert len(seen["rows"]) == 3 and {(r.raw, r.trusted) for r in seen["rows"]} == {(n + 3, n + 1)}


# 2 token files

@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_tokenizer(name, spaces):
    draw = random.Random(5)
    bits = list("ab Ze1 2\n\t .,!?'|#_") + ["'s", "  ", "\n\n", "\r\n", "é", "ß", "Σ", "İ", "中", " ", " ", "́", "\x1c", "<|endoftext|>", "²", "–", "​", " |"]
    some = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 30))) for _ in range(4000)]
    encoder = tokens.Encoder(tokens.public_file(name), spaces)
    assert encoder.encode(some) == encoder._whole(some) == encoder.encode(some)


def whole_ids(name, texts, end):
    coded = tokens.tokenizer(tokens.public_file(name)).encode_batch(texts, add_special_tokens=False)
    return [np.array([*c.ids, end], "<u4") for c in coded]


def test_token_files(spark, data, texts):
    start, want = 0, []
    for i, ids in zip(sorted(texts), whole_ids("byte_bpe_50k.json", [texts[i] for i in sorted(texts)], 2)):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in query(spark, data, 2)) == want


def test_token_files_on_odd_rows_and_pruning(spark, odd, none):
    path = token_files.write_token_files(odd, stage_path(spark, "t"))
    stored = token_files.read_token_files(spark, path)
    rows = sorted(token_files.token_digest(stored).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 0, 0, 1, 1, 2, 3, 4, 5, 6, 9]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    one = stored.where("doc_id = 3")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in one._jdf.queryExecution().toString()
    empty = token_files.write_token_files(none, stage_path(spark, "t"))
    assert token_files.token_digest(token_files.read_token_files(spark, empty, stored.schema)).count() == 0


# 3 secrets

def test_scan_by_hand():
    text = 'password = "abc" Secret:abcdef token=token"=abcdef ' + "AKIA" + "Z" * 16 + " " + "a1" * 12 + " ghp_" + "x" * 36
    found = [(text[a:b], kind) for a, b, kind in secrets.scan(text)]
    assert found == [("Secret:abcdef", "assign"), ("AKIA" + "Z" * 16, "access"), ("a1" * 12, "hex"), ("ghp_" + "x" * 36, "git_token")]


def test_ledger_scans_each_blob_once(spark, odd, none):
    ledger = stage_path(spark, "ledger")
    blobs = odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert secrets.update_ledger(none, ledger) == 0
    assert secrets.update_ledger(odd, ledger) == blobs and secrets.update_ledger(odd, ledger) == 0
    assert secrets.update_ledger(odd.withColumn("text", F.lit("new")), ledger) == 1
    assert secrets.update_ledger(odd, ledger, version="2") == blobs
    rows = secrets.findings(odd, ledger).collect()
    assert len(rows) == odd.count() and [(r.doc_id, r.spans) for r in rows if r.spans] == [(3, "assign:0:17")]
    masked = secrets.mask_secrets(odd, ledger, length_col="n_chars")
    assert masked.columns == odd.columns and [(r.text, r.n_chars) for r in masked.where("doc_id = 3").collect()] == [("[secret]", 8)]
    assert masked.exceptAll(odd).count() == 1 and masked.count() == odd.count()


# 4 nearest neighbours

def test_chi_square():
    assert ann.chi_square_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-6)
    assert ann.chi_square_quantile(0.99, 16) == pytest.approx(31.99993, abs=1e-5)


def exact_neighbours(vectors, k=5):
    ids = np.array(sorted(vectors))
    table = np.array([vectors[i] for i in ids], float)
    for q in ids[ids % 50 == 0]:
        scores = ann.cosine(table, np.array(vectors[q], float))
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        yield int(q), [(int(ids[i]), float(scores[i])) for i in order]


def test_recall(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    found = defaultdict(dict)
    for r in query(spark, data, 4):
        found[r.query_id][r.vec_id] = r.score
    hits = [(i in found[q], found[q].get(i, s) == s) for q, top in exact_neighbours({r.vec_id: r.embedding for r in rows}) for i, s in top]
    assert np.mean([h for h, _ in hits]) >= 0.95 and all(same for _, same in hits)


def test_neighbours_on_odd_vectors(spark):
    draw = np.random.default_rng(1)
    good = [(int(i), [float(x) for x in draw.normal(size=6)], "x", 1) for i in range(1, 300)]
    odd = [(0, good[0][1], "x", 1), (300, good[0][1], "x", 1), (301, good[0][1], "x", 1), (302, None, "x", 1), (303, [0.0] * 6, "x", 1), (304, [float("nan")] * 6, "x", 1), (305, [float("inf")] * 6, "x", 1), (306, [1.0], "x", 1), (None, good[0][1], "x", 1), (300, good[0][1], "x", 1)]
    odd.append((307, [None] * 6, "x", 1))
    table = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>, id string, cell int")
    rows = ann.nearest(table, table.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    vectors = {r[0]: r[1] for r in good + odd[:3]}
    want = [(q, n + 1, i, s) for q, top in exact_neighbours(vectors) for n, (i, s) in enumerate(top)]
    assert [tuple(r) for r in rows] == want and [r.vec_id for r in rows if r.query_id == 0][:3] == [1, 300, 301]
    few = ann.nearest(table.where("vec_id < 3"), table.where("vec_id = 0"))
    assert sorted(r.vec_id for r in few.collect()) == [1, 2]
    assert ann.nearest(table.limit(0), table).count() == 0 == ann.nearest(table, table.limit(0)).count()


def test_many_copies_of_a_query(spark):
    """More copies than a leaf holds: the smallest ids are found, wherever they lie."""
    draw = np.random.default_rng(4)
    for vec in draw.normal(size=(6, 64)).tolist():
        ids = draw.permutation(np.arange(1, 3001))
        rows = ann.pd.DataFrame({"id": ids, "vec": [vec] * 3000})
        ask = ann.pd.DataFrame({"id": [5000], "vec": [vec], "bound": [4.0]})
        found = ann._search(rows, ask, 5, ann.DIMENSIONS, ann.chi_square_quantile(ann.CONFIDENCE, ann.DIMENSIONS))
        assert found["vec_id"].tolist() == [1, 2, 3, 4, 5]


# 5 html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<div id=cookie-notice>We use cookies, yes.</div><nav><ul><li><a href=/a>Home</a></ul></nav>%s<aside>Aside, with text.</aside>
<div class="ad">Buy now, now!</div><form>Name: <input> please, enter.</form><section class="comments"><p>First comment, long, with, commas.</section><footer>&copy; 2020, all rights.</footer>"""
BODY = "<h1>Head &amp; line</h1><p><b>First paragraph,   with\n two lines.<br><p>Second &lt;one&gt;, longer, with more. <a href=x>link</a>.</p><!-- no --><ul><li>item one, here.<li>item two, there.</ul>"
WANT = "Head & line\nFirst paragraph, with two lines.\nSecond <one>, longer, with more. link.\nitem one, here.\nitem two, there."


def test_extract_articles_and_plain_pages():
    assert html_extract.extract(PAGE % f"<article><header>By me<h1>Title</h1></header>{BODY}<div class=share>Share, it.</div></article>") == "Title\n" + WANT
    assert html_extract.extract(PAGE % f"<main>{BODY}</main>") == WANT
    assert html_extract.extract(PAGE % f"<div class=page><div class=story>{BODY}</div></div>") == WANT
    assert html_extract.extract("") == "" == html_extract.extract("<html><nav>x</nav>")
    assert html_extract.extract("<article><p>cut off, here <a href='x") == "cut off, here"


def test_paths_are_scored_inside_and_outside_of_articles():
    text = "A sentence of the article, with some words and marks; it goes on for a while. " * 4
    body = f"<h1><a href=x>Title</a></h1><p>{text}<p>{text}<table><tr><td>a<td>12</table><ul><li>one<li>two</ul>"
    want = ["Title", text.strip(), text.strip(), "a", "12", "one", "two"]
    for inside in ("<div>Buy cheap now</div>", "<div><a href=x>Tweet</a> <a href=y>Mail this</a></div>", "<ul class=x><div><li><a href=x>More, of this</a></div></ul>"):
        assert html_extract.extract(f"<article>{body}{inside}<p>{text}</article>").split("\n") == [*want, text.strip()]
    # Text beside an article counts, a line beside it does not.
    page = f"<body><article>{body}</article><div><div><p>{text}</div>{text}</div><center>All of us</center>"
    assert html_extract.extract(page).split("\n") == [*want, text.strip(), text.strip()]
    assert html_extract.extract("<article><p><a href=x>All is a link</a></p></article>") == "All is a link"


def test_text_without_punctuation_is_kept():
    lines = [f"line {i} of a verse that ends without a mark" for i in range(8)]
    assert html_extract.extract("<body>" + "".join(f"<p>{x}</p>" for x in lines)) == "\n".join(lines)
    assert html_extract.extract("<div>ข้อความภาษาไทย</div>") == "ข้อความภาษาไทย"
    # Cells with no punctuated direct neighbour, between two paragraphs.
    cells = [f"cell {i}" for i in range(6)]
    page = "<p>Before, with marks.</p><table><tr>" + "".join(f"<td>{x}</td>" for x in cells) + "</tr></table><p>After, with marks.</p>"
    assert html_extract.extract(page).split("\n")[1:-1] == cells


def test_extract_on_tables(spark, data):
    rows = query(spark, data, 5)
    assert len(rows) == spark.read.parquet(f"{data}/pages.parquet").count() and all(r.n_chars == len(r.text) > 0 for r in rows)
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "", "x"), (2, "u", "<article>" + "<p>a, b.</p>" * 50_000, "x")], "page_id long, url string, html string, id string")
    got = sorted((r.page_id or 0, r.n_chars) for r in html_extract.extract_main_text(odd).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 50_000 * 6 - 1)] and html_extract.extract_main_text(odd.limit(0)).count() == 0


# 6 mixing

def test_mix_on_odd_rows(odd, none):
    rows = mixing.mix_sizes(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    total, by = sum(r.size for r in rows), defaultdict(list)
    for r in rows:
        by[r.source_size, r.target].append(r.taken)
    assert sum(t for _, t in by) == pytest.approx(1.5 * total)
    assert all(abs(sum(taken) - target) <= 3 for (_, target), taken in by.items())
    mixed = mixing.mix(odd, length_col="n_chars")
    assert mixed.columns == odd.columns
    words = sum(len(WORD.findall(r.text)) for r in mixed.collect())
    assert words == sum(r.taken for r in rows)
    assert mixing.mix_sizes(none).count() == 0 == mixing.mix(none).count()


def test_shards_split_exactly(spark, documents):
    _, planned = mixing.plan(documents)
    draws = [d for r in planned.collect() for d in (r.drawn or [])]
    by = Counter(d.shard for d in draws)
    assert sorted(by) == list(range(16)) and max(by.values()) - min(by.values()) <= 1
    shards = mixing.mix(documents, shard_col="shard").groupBy("shard").count().collect()
    assert len(shards) == 16


# 7 packing

def best_fit_slowly(lengths, capacity):
    left, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [b for b in range(len(left)) if left[b] >= lengths[i]]
        b = min(fits, key=lambda b: left[b]) if fits else len(left)
        left += [] if fits else [capacity]
        left[b] -= lengths[i]
        out[i] = b
    return left


def test_best_fit_equals_the_plain_one():
    draw = np.random.default_rng(2)
    for _ in range(20):
        lengths = draw.integers(1, 100, 200)
        bins = packing.best_fit(lengths, 100)
        assert sorted(100 - np.bincount(bins, weights=lengths)) == sorted(best_fit_slowly(lengths.tolist(), 100))


def check_packed(rows, want, capacity):
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= capacity
    return len(places)


def test_packing(spark, data, texts):
    want, total = [], 0
    for i, ids in zip(texts, whole_ids("word_bpe_49k.json", list(texts.values()), 1)):
        total += len(ids)
        want += [(i, n, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())) for n, s in enumerate(range(0, len(ids), 4096))]
    assert check_packed(query(spark, data, 7), want, 4096) <= -(-total // 4096) + 1


def test_packing_in_rounds(spark, odd, none):
    draw = random.Random(3)
    sizes = [draw.randint(0, 60) for _ in range(900)]
    docs = spark.createDataFrame([(i, "a " * n) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(40)
    ids = lambda texts: [np.arange(t.count("a"), dtype="<u4").tobytes() for t in texts]
    want = [(i, 0, 0, n + 1, zlib.crc32(np.array([*range(n), 1], "<u4").tobytes())) for i, n in enumerate(sizes)]
    bins = check_packed(packing.pack(docs, encode=ids, capacity=64, slack=0).collect(), want, 64)
    # Forty tasks of 22 items each leave bins that later rounds cannot take apart.
    assert bins <= 1.1 * sum(n + 1 for n in sizes) / 64
    pieces = packing.pack(odd).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("length").alias("t")).collect()
    assert {r.doc_id: (r.n, r.t) for r in pieces}[1] == (2, 2) and len(pieces) == 9
    assert packing.pack(none).count() == 0


# 8 simhash

def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """{node: smallest node reachable} over all pairs."""
    nodes = sorted(prints)
    values, root = np.array([prints[n] for n in nodes], np.uint64), {n: n for n in nodes}
    for i, n in enumerate(nodes):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 3) + i + 1:
            a, b = root[n], root[nodes[j]]
            if a != b:
                for k in nodes:
                    if root[k] == max(a, b):
                        root[k] = min(a, b)
    return root


def test_near_duplicates(spark, data, texts):
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    root = slow_components(prints)
    want = {(i, f"{p:016x}", root[i]) for i, p in prints.items()}
    assert {tuple(r) for r in query(spark, data, 8)} == want


@pytest.mark.parametrize("group_rows", [simhash.GROUP_ROWS, 40])
def test_links_keep_every_component(spark, group_rows):
    draw = random.Random(4)
    prints = {draw.getrandbits(64) for _ in range(300)}
    for centre in list(prints)[:6]:
        for _ in range(150):
            prints.add(centre ^ sum(1 << b for b in draw.sample(range(22), draw.randint(1, 5))))
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r.node: r.root for r in components.components(simhash.links(table, group_rows)).collect()}
    want = slow_components(signed)
    assert {n: found.get(n, n) for n in signed} == want


def test_near_duplicates_on_odd_rows(odd, none):
    rows = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    got = {(i, c) for i, _, c in rows}
    assert len(rows) == odd.count() and {(6, 0), (None, 0), (5, 1), (2, 1), (None, 1)} <= got and (1, "0" * 16, 1) in rows
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4, 9]
    assert simhash.near_duplicates(none).count() == 0 == simhash.drop_near_duplicates(none).count()


# 9 toxicity

def test_interactions_are_learned(spark):
    """Two words that only count together: no additive weights separate these rows."""
    draw = random.Random(6)
    rows = [(i, " ".join(["insultx"] * (i & 1) + ["groupx"] * (i >> 1 & 1) + [draw.choice(["aaaa", "bbbb", "cccc"])]), int(i & 3 == 3)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, machine).collect()}
    assert all(scored[i] == t for i, _, t in rows)


def test_training_in_full():
    """Rank 8 and 300 steps over all rows, against a plain dense version of the same steps."""
    draw = np.random.default_rng(3)
    x = (draw.random((40, 9)) < 0.4).astype(float)
    x[5] = 0
    y = ((x[:, 0] * x[:, 1] + x[:, 2]) > 0).astype(float)
    bias, weights, vectors = toxicity.train([np.flatnonzero(r).tolist() for r in x], y, 9)
    share = y.mean()
    v = [np.array([np.log(share / (1 - share))]), np.zeros(9), np.random.default_rng(toxicity.SEED).normal(0, 0.01, (9, 8))]
    m, s = [np.zeros_like(a) for a in v], [np.zeros_like(a) for a in v]
    for step in range(1, 301):
        total = x @ v[2]
        error = 1 / (1 + np.exp(-(v[0] + x @ v[1] + 0.5 * (total**2 - x @ v[2] ** 2).sum(axis=1)))) - y
        slopes = [np.array([error.sum()]), x.T @ error, x.T @ (error[:, None] * total) - v[2] * (x.T @ error)[:, None]]
        for i, g in enumerate(slopes):
            g = g / 40 + (1e-5 * v[i] if i else 0)
            m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.999 * s[i] + 0.001 * g * g
            v[i] = v[i] - 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-9)
    assert vectors.shape == (9, 8) and np.allclose(bias, v[0], atol=1e-3) and np.allclose(weights, v[1], atol=1e-3) and np.allclose(vectors, v[2], atol=1e-3)


def test_toxicity_held_out(spark):
    big = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in query(spark, big, 9)}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    held = [(rows[i].predicted, t) for i, t in labels.items() if i in rows and rows[i].held_out]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in labels if i in rows)
    caught, flagged = [p for p, t in held if t], [p for p, t in held if not t]
    # About a tenth of the texts labelled toxic here hold none of the words that mark the others.
    assert np.mean(caught) >= 0.85 and np.mean(flagged) <= 0.005


def test_toxicity_on_odd_rows(odd, none):
    labels = odd.sparkSession.createDataFrame([(0, 1), (4, 0), (None, 1), (0, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0), labels.where("toxic = 1")):
        scored = toxicity.toxicity_scores(odd, toxicity.fit(odd, known)).collect()
        assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.toxicity_scores(none, toxicity.fit(none, labels)).count() == 0


# 10 warc

def pages(spark):
    rows = [(1, "u", "<p>x</p>", "x"), (2, "u\nv", "<p>x</p>", "x"), (3, None, None, "x"), (None, "u", "", "x"), (4, "u", "é WARC/1.1\r\n\r\n", "x"), (2, "u", "<p>x</p>", "x"), (5, "w", "y" * 300_000, "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, id string")


def test_warc_round_trip(spark):
    path = warc.write_warc(pages(spark), stage_path(spark, "warc"))
    rows = warc.read_warc(spark, path).collect()
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, None if r.payload is None else bytes(r.payload).decode()) for r in rows)
    assert got == Counter([
        ("1", "revisit", "2", 8, None), ("2", "response", None, 8, "<p>x</p>"), ("2", "response", None, 8, "<p>x</p>"), ("3", "response", None, 0, ""),
        (None, "revisit", "3", 0, None), ("4", "response", None, 15, "é WARC/1.1\r\n\r\n"), ("5", "response", None, 300_000, "y" * 300_000),
    ])
    assert all(r.kind == "record" for r in rows)
    empty = warc.write_warc(pages(spark).limit(0), stage_path(spark, "warc"))
    assert warc.read_warc(spark, empty).count() == 0


def record(name, body):
    digest = __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%s>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (name, digest.encode(), len(body), body)


def test_records_of_ordinary_crawls():
    body = b"<p>x</p>\r\n\r\ny"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    b32 = lambda data: __import__("base64").b32encode(hashlib.sha1(data).digest())

    def crawled(block, *lines):
        head = b"\r\n".join((b"WARC/1.0", b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:1>", b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block), *lines))
        return head + b"\r\n\r\n" + block + b"\r\n\r\n"

    payload, whole = b"WARC-Payload-Digest: sha1:", b"WARC-Block-Digest: sha1:"
    for lines in ((payload + b32(body), whole + b32(block)), (payload + hashlib.sha1(body).hexdigest().encode(),), (b"WARC-Payload-Digest: sha256:" + hashlib.sha256(body).hexdigest().encode(),), (b"WARC-Payload-Digest: md9:zz",), ()):
        assert [part[0] for part in warc.salvage(crawled(block, *lines))] == ["record"]
    for lines in ((payload + b32(body + b"z"),), (payload + b32(body), whole + b32(body)), (b"WARC-Payload-Digest: sha256:" + b"0" * 64,)):
        assert [part[0] for part in warc.salvage(crawled(block, *lines))] == ["gap"]


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    import gzip

    parts = [record(b"%d" % i, b"body %d " % i * 50) for i in range(5)]
    if packed:
        parts = [gzip.compress(p) for p in parts]
    broken = bytearray(parts[1])
    broken[len(broken) // 2] ^= 0xFF
    data = b"junk" + parts[0] + bytes(broken) + parts[2] + parts[3][: len(parts[3]) // 2] + parts[4] + b"tail"
    found = list(warc.salvage(data))
    assert [f[3]["warc-record-id"] for f in found if f[0] == "record"] == ["<urn:page:0>", "<urn:page:2>", "<urn:page:4>"]
    spans = [(a, b) for _, a, b, _, _ in found]
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    assert [f[0] for f in found] == ["gap", "record", "gap", "record", "gap", "record", "gap"]


# pipeline

def test_pipeline_stages(spark, data, documents):
    import corpus_pipeline

    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == documents.columns and [t for _, t in out.dtypes] == [t for _, t in documents.dtypes]
        rows = out.collect()
        seen.append({r.doc_id for r in rows})
        docs = spark.createDataFrame(rows, documents.schema)
    kept = {r.doc_id for r in query(spark, data, 1) if r.kept}
    assert seen[0] == kept and seen[1] < kept and seen[2] == seen[1] and seen[3] <= seen[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in packed} == seen[3]
    assert sorted((r.doc_id, r.piece) for r in packed) == sorted((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, data).collect())
