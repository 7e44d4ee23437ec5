"""Filter audit, periodic runs and substring removal against brute force, and on odd rows."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.llm import audit, queries, runs, substrings

DOCS = "doc_id long, text string, source string, id long, part string, n long, grp long, k int, low long, mask int, chunk long, blob string, kept string, runs string, w string, a int"
LONG = "lorem ipsum dolor " * 30_000


def doc(i, text, source="s"):
    return (i, text, source, 1, "x", 1, 1, 1, 1, 1, 1, "x", "x", "x", "x", 1)


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, text and source, empty and very long texts, ties, repeated rows, clashing names."""
    some = " ".join(f"w{i}" for i in range(30))
    rows = [doc(0, some), doc(1, ""), doc(2, None), doc(3, " \n\t "), doc(4, LONG), doc(5, LONG + "x"), doc(6, some + " tail"), doc(0, some), doc(None, some), doc(None, None, None), doc(7, "É " * 40, None), doc(8, "x" * 100_000)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# 11 filter audit

def brute_masks(rows):
    out = []
    for i, text, source in rows:
        text = text or ""
        words = text.encode().split()
        capitals = sum("A" <= c <= "Z" for c in text)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text), any(c in "#$%&*|" for c in text), i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows))
        out.append((i, source or "", sum(f << b for b, f in enumerate(fails))))
    return out


def brute_audit(masks, good, toxic):
    table, parts = {}, {p for _, p, _ in masks}
    for part in parts:
        for order in permutations("ABCDE"):
            left = [(i, m) for i, p, m in masks if p == part]
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                out = [x for x in left if x[1] & bit]
                failing = [m for _, p, m in masks if p == part and m & bit]
                left = [x for x in left if not x[1] & bit]
                table[part, "".join(order), step] = [len(left), len(out), len(failing) - len(out), sum(m == bit for m in failing), sum(i in good for i, _ in out), sum(i in toxic for i, _ in out)]
    for (part, order, step), row in list(table.items()):
        row.append(sum(r[1] for (p, o, s), r in table.items() if p == part and o[s - 1] == order[step - 1] and len(r) >= 2))
    return table


def test_own_failures_by_hand():
    assert audit.own_failures(b"") == 1
    assert audit.own_failures(b"a " * 200) == 2 and audit.own_failures(" ".join(map(str, range(200))).encode()) == 0
    assert audit.own_failures("É".encode() * 49 + b"A") == 1 and audit.own_failures("É".encode() * 48 + b"A") == 5
    assert audit.own_failures(b"a|b") == 9


def test_trie_holds_the_smallest_id_of_every_text():
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab") for _ in range(draw.randint(0, 8))).encode() for _ in range(3000)] + [b"ab" * 50_000, b"ab" * 50_000 + b"a"]
    root, ends, least = audit.Trie(), {}, {}
    for i in draw.sample(range(len(texts)), len(texts)):
        ends[texts[i]] = root.insert(texts[i], i)
        least[texts[i]] = min(i, least.get(texts[i], i))
    assert {t: e.low for t, e in ends.items()} == least
    stack, found = [(root, b"")], {}
    while stack:
        node, text = stack.pop()
        if node.low is not None:
            found[text] = node.low
        stack += [(n, text + n.label) for n in node.next.values()]
        assert all(n.label[0] == c for c, n in node.next.items())
    assert found == least


def test_cuts_part_texts_with_a_long_common_head(monkeypatch):
    monkeypatch.setattr(audit, "CUT_BYTES", 2000)
    head = b"same " * 300
    cuts = audit.proposed_cuts([head + bytes([c]) + b"tail" for c in range(97, 120)])
    assert cuts and all(c.startswith(head) and len(c) == len(head) + 1 for c in cuts) and cuts == sorted(cuts)


def test_masks_and_orders_equal_brute_force(spark, odd):
    draw = random.Random(1)
    texts = [" ".join(draw.choice(["Abc", "d", "e#", "f", str(draw.randint(0, 9))]) for _ in range(draw.randint(0, 260))) for _ in range(40)]
    rows = [(draw.randint(0, 50), draw.choice(texts), draw.choice(["p", "q", None, ""])) for _ in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = audit.failure_masks(table).collect()
    want = brute_masks(rows)
    assert Counter(tuple(r) for r in got) == Counter(want)
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(60)] + [(2, 1, False), (None, 1, True)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    rows = audit.filter_audit(table, labels).collect()
    want = brute_audit(want, {i for i in range(60) if i % 2} | {2}, set(range(0, 60, 3)))
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows} == want
    assert len(rows) == 3 * 600


def test_many_ranges_and_groups_change_nothing(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = Counter(tuple(r) for r in audit.failure_masks(docs).collect())
    monkeypatch.setattr(audit, "TRIE_BYTES", 20_000)
    real = audit._cuts
    monkeypatch.setattr(audit, "_cuts", lambda proposed, n: sorted({b"a", b"m", b"the "} | set(real(proposed, n))))
    assert Counter(tuple(r) for r in audit.failure_masks(docs.repartition(13)).collect()) == want


def test_audit_of_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert Counter(tuple(r) for r in audit.failure_masks(odd).collect()) == Counter(brute_masks(rows))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit.filter_audit(odd, labels)
    assert got.count() == 2 * 600 and got.agg(F.sum("good_lost")).first()[0] == 0
    assert audit.filter_audit(none, labels).count() == 0 and audit.failure_masks(none).count() == 0


# 12 periodic runs

def brute_runs(words):
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and not any(p < q and s <= i and s + n >= j + q for s, n, p in found):
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found)


def codes(words):
    names = {}
    return np.array([names.setdefault(w, len(names)) for w in words], np.int64)


def test_runs_equal_brute_force():
    draw = random.Random(4)
    for turn in range(400):
        words = []
        while len(words) < draw.choice((30, 120, 600)):
            unit = [draw.choice("abc" if turn % 2 else "ab") for _ in range(draw.choice((1, 2, 3, 8, 16, 17, 30, 33, 70)))]
            words += unit * draw.choice((1, 1, 2, 3, 4, 9)) + unit[:draw.randint(0, len(unit))]
            if draw.random() < 0.5:
                words.append(f"x{draw.randint(0, 3)}")
        assert runs.periodic_runs(codes(words)) == brute_runs(words), words


def test_runs_of_hard_texts():
    for words in (["a"] * 5000, list("ab" * 2000), ["a"] * 24, ["a"] * 23, list(range(9)) * 3, list(range(8)) * 3, list(range(100)) * 3, list(range(100)) * 3 + [0], []):
        assert runs.periodic_runs(codes(words)) == brute_runs(words)
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 2000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert runs.periodic_runs(codes(fibonacci[-1])) == brute_runs(list(fibonacci[-1]))
    # Every gram of 16 words stands twice in the period, so only a longer gram returns after exactly one period.
    p, q, r, s = (list(range(20 * i, 20 * i + 20)) for i in range(4))
    unit = p + q + p + r + p + q + s + r + s + q + s + r
    assert runs.periodic_runs(codes(unit * 3)) == brute_runs(unit * 3) == [(0, 3 * len(unit), len(unit))]


def test_collapse_keeps_one_period():
    words = [b"x", *[b"a", b"b"] * 12, b"a", b"y"]
    assert runs.text_runs(b" ".join(words))[1] == [(1, 25, 2)] and runs.collapse(words, [(1, 25, 2)]) == b"x a b y"


def test_runs_of_odd_rows(odd, none):
    got = runs.find_runs(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    by_id = {r.doc_id: r for r in got}
    assert [tuple(r) for r in by_id[4].runs] == [(0, 90_000, 3)] and by_id[4].collapsed == "lorem ipsum dolor"
    assert by_id[7].collapsed == "É" and by_id[2].n_words == 0 and by_id[2].collapsed == "" and by_id[8].runs == []
    assert runs.find_runs(none).count() == 0


def test_strongest_run_breaks_ties_by_start_then_period(spark):
    rows = [([(5, 24, 8), (2, 30, 10), (40, 27, 9)],), ([(0, 50, 2), (60, 26, 1)],), ([],)]
    got = spark.createDataFrame(rows, runs.RUN.simpleString().join(("runs ", ""))).select(runs.strongest_run().alias("b")).collect()
    assert [r.b and tuple(r.b) for r in got] == [(5, 24, 8), (60, 26, 1), None]


def test_looped_texts_equal_the_rule(spark, data):
    import zlib

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "a b"), (-31, None)], "doc_id long, text string"))
    got = {r.doc_id: (r.text or "").encode().split() for r in queries.looped(docs).collect()}
    changed = 0
    for r in docs.collect():
        words = (r.text or "").encode().split()
        if r.doc_id is not None:
            h = zlib.crc32(str(r.doc_id).encode())
            g, n = h // 10, len(words)
            if h % 10 == 0 and n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
                changed += 1
        assert got[r.doc_id] == words
    assert changed > 5


# 13 substring removal

def brute_kept(rows):
    windows = {}
    for i, words in rows:
        for s in range(len(words) - 19):
            w, place = tuple(words[s:s + 20]), (float("inf") if i is None else i, s)
            windows[w] = min(place, windows.get(w, place))
    out = []
    for i, words in rows:
        gone = set()
        for s in range(len(words) - 19):
            if windows[tuple(words[s:s + 20])] < (float("inf") if i is None else i, s):
                gone.update(range(s, s + 20))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def passages(draw, n):
    pool = [[f"w{draw.randint(0, 9 if turn % 3 else 60)}" for _ in range(draw.randint(15, 60))] for turn in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randint(0, 5)):
            part = list(draw.choice(pool))
            if draw.random() < 0.4:
                part[draw.randrange(len(part))] = "changed"
            words += part * draw.choice((1, 1, 1, 3))
        rows.append((draw.choice((i, i, i, None, n - i)), words))
    return rows


@pytest.mark.parametrize("common", [3, 20_000])
def test_removal_equals_brute_force(spark, common):
    """Also with so few places per anchor allowed that windows go on their own, in small chunks and shards."""
    rows = passages(random.Random(common), 150)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in substrings.drop_repeated_passages(docs, chunk_bytes=4000, shard_bytes=3000, common=common).collect())
    assert got == Counter(brute_kept(rows))


def test_automaton_matches_like_a_search():
    draw = random.Random(8)
    for _ in range(150):
        texts = [[draw.choice("abc") for _ in range(draw.randint(1, 25))] for _ in range(5)]
        made = substrings.SuffixAutomaton()
        for i, t in enumerate(texts):
            made.add(t, (i, 0))
        probe = [draw.choice("abcd") for _ in range(30)]
        for k, end in enumerate(made.first_ends(probe, 4)):
            want = [(i, s + 3) for i, t in enumerate(texts) for s in range(len(t) - 3) if t[s:s + 4] == probe[k - 3:k + 1]] if k >= 3 else []
            assert end == (min(want) if want else None)


def test_common_anchors_send_their_windows_alone():
    draw = random.Random(2)
    words = " ".join(draw.choice("abcdefgh") for _ in range(400))
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    batch = pa.record_batch([pa.array([1, 2], pa.int64()), pa.array([words, "x y"])], names=["id", "text"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    chunk = substrings.Chunk(sink.getvalue().to_pybytes())
    assert chunk.counts.sum() == 381 and chunk.counts.max() <= 20 and (np.diff(chunk.starts) == chunk.counts[:-1]).all()
    marks = {shard: b"\x02" * len(a) for shard, a, _ in chunk.anchor_counts(3)}
    sent = [(s, c) for some in chunk.repeated(3, marks) for s, c in zip(some.starts, some.counts)]
    assert sorted(sent) == [(i, 1) for i in range(381)]


def test_removal_of_odd_rows(odd, none):
    got = Counter(tuple(r) for r in substrings.drop_repeated_passages(odd).collect())
    assert got == Counter(brute_kept([(r.doc_id, (r.text or "").split()) for r in odd.collect()]))
    assert substrings.drop_repeated_passages(none).count() == 0


def test_digest_is_of_the_kept_text(odd):
    text = {(r.doc_id, r.kept) for r in substrings.drop_repeated_passages(odd).collect()}
    got = {(r.doc_id, bytes(r.kept)) for r in substrings.drop_repeated_passages(odd, digest=queries._sha256).collect()}
    assert got == {(i, hashlib.sha256(t.encode()).digest()) for i, t in text}
