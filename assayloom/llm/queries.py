"""Registered queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from assayloom.llm import ann, audit, html_extract, mixing, packing, quality, runs, secrets, simhash, substrings, token_files, toxicity, warc
from assayloom.plans.catalogue import Tables, register
from assayloom.session import stage_path

_WORD = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines FROM docs),
tok AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM words),
win AS (SELECT rid, i, [word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w] AS g, lead(word, 4) OVER w IS NOT NULL AS whole FROM tok WINDOW w AS (PARTITION BY rid ORDER BY i)),
often AS (SELECT rid, unnest(list(i)) AS i FROM win WHERE whole GROUP BY rid, g HAVING count(*) > 1),
repeats AS (SELECT rid, count(DISTINCT i + k) AS n FROM often, (SELECT unnest(range(5)) AS k) GROUP BY rid),
base AS (
  SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - list_unique(lines))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM words w LEFT JOIN repeats r USING (rid)),
parts AS (SELECT rid, i, word, rtrim(word, '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~') AS core FROM tok),
tokens AS (
  SELECT rid, 2 * i AS i, core AS t FROM parts WHERE core <> '' UNION ALL
  SELECT rid, 2 * i + 1, substr(word, length(core) + 1) FROM parts WHERE length(core) < length(word)),
coded AS (SELECT rid, i, ('0x' || substr(md5(t), 1, 8))::BIGINT % 8192 AS b FROM tokens),
grams AS (
  SELECT rid, b FROM coded UNION ALL
  SELECT rid, (prev * 31 + b) % 8192 FROM (SELECT rid, b, lag(b) OVER (PARTITION BY rid ORDER BY i) AS prev FROM coded) WHERE prev IS NOT NULL),
good AS (SELECT DISTINCT rid FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
counts AS (SELECT b, count(*) AS r, count(good.rid) AS t FROM grams LEFT JOIN good USING (rid) GROUP BY b),
sums AS (SELECT sum(r) AS r, sum(t) AS t FROM counts),
weights AS (SELECT b, CASE WHEN s.t = 0 THEN 0 ELSE (ln(c.t + 1) - ln(s.t + 8192)) - (ln(c.r + 1) - ln(s.r + 8192)) END AS w FROM counts c, sums s),
scores AS (SELECT rid, count(*) AS n, sum(w) / count(*) AS score FROM grams JOIN weights USING (b) GROUP BY rid),
judged AS (SELECT base.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(n, 0)::BIGINT AS n_grams, coalesce(score, 0)::DOUBLE AS raw FROM base LEFT JOIN scores USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_grams, round(raw, 6) AS score, NOT base_failed AND raw >= -0.25 AS kept FROM judged"""


@register("op1_quality_rules", OP1_SQL)
def op1(spark, d):
    t = Tables(spark, d)
    return quality.quality_scores(t.documents, t.labels).withColumn("score", F.round("score", 6))


@register("op2_token_files")
def op2(spark, d):
    path = token_files.write_token_files(Tables(spark, d).documents, stage_path(spark, "token-files"))
    return token_files.token_digest(token_files.read_token_files(spark, path))


def _spans_sql() -> str:
    """One UNION arm per kind: matches, the texts between them, and from both the spans."""
    rules = {"assign": f"(?i:{secrets.ASSIGN.pattern})", "access": secrets.ACCESS.pattern, "hex": secrets.HEX.pattern} | {k: r.pattern for k, r in secrets.FURTHER.items()}
    arms = []
    for place, kind in enumerate(secrets.KINDS):
        rule = rules[kind].replace("'", "''")
        fits = {"assign": f"length(regexp_extract_all(text, '{rule}', 2)[k]) >= {secrets.MIN_ASSIGN}", "access": f"length(ms[k]) >= {secrets.MIN_ACCESS}"}.get(kind, "true")
        arms.append(f"""
        SELECT rid, {place} AS place, '{kind}' AS kind, a, a + length(ms[k]) AS b FROM (
          SELECT rid, text, ms, k, (coalesce(list_sum(list_transform(gaps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::BIGINT AS a FROM (
            SELECT rid, text, ms, gaps, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT rid, text, regexp_extract_all(text, '{rule}') AS ms, regexp_split_to_array(text, '{rule}') AS gaps FROM docs))) WHERE {fits}""")
    return " UNION ALL ".join(arms)


OP3_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_spans_sql()}),
joined AS (
  SELECT rid, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) FILTER (place < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (rid)"""


@register("op3_secret_scan", OP3_SQL)
def op3(spark, d):
    docs, ledger = Tables(spark, d).documents, stage_path(spark, "ledger")
    secrets.update_ledger(docs, ledger)
    found = secrets.findings(docs, ledger)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


@register("op4_nearest_neighbours")
def op4(spark, d):
    vectors = Tables(spark, d).embeddings
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@register("op5_html_extraction")
def op5(spark, d):
    return html_extract.extract_main_text(Tables(spark, d).pages)


OP6_SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS h, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, coalesce('s' || source, '') AS key FROM documents),
blocks AS (SELECT key, substr(h, 1, 2) AS block, sum(size)::BIGINT AS size FROM docs GROUP BY ALL),
sources AS (SELECT key, source, sum(size)::BIGINT AS source_size FROM docs GROUP BY ALL),
weighed AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sources),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
goals AS (SELECT key, source_size, least(cap, weight * (SELECT first(level ORDER BY ratio, key) FROM levels WHERE level <= ratio))::DOUBLE AS target FROM levels),
ordered AS (
  SELECT b.*, turn, coalesce(sum(size) OVER (PARTITION BY key ORDER BY turn, md5('mix|' || key || '|' || block || '|' || turn), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blocks b, (SELECT unnest([0, 1]) AS turn) WHERE size > 0),
drawn AS (SELECT key, block, size, least(size, floor(target + 0.5) - before)::BIGINT AS need FROM ordered JOIN goals USING (key) WHERE before < floor(target + 0.5)),
fulls AS (SELECT key, block, count(*) AS n FROM drawn WHERE need = size GROUP BY ALL),
edges AS (SELECT key, block, need FROM drawn WHERE need < size),
placed AS (
  SELECT d.*, coalesce(n, 0) AS n, need, coalesce(sum(d.size) OVER (PARTITION BY d.key, substr(h, 1, 2) ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d LEFT JOIN fulls f ON f.key = d.key AND f.block = substr(h, 1, 2) LEFT JOIN edges e ON e.key = d.key AND e.block = substr(h, 1, 2))
SELECT doc_id, size, source_size, target, (n * size + CASE WHEN need IS NULL THEN 0 ELSE greatest(0, least(size, need - before)) END)::BIGINT AS taken FROM placed JOIN goals USING (key)"""


@register("op6_mixing", OP6_SQL)
def op6(spark, d):
    return mixing.mix_sizes(Tables(spark, d).documents)


@register("op7_packing")
def op7(spark, d):
    return packing.pack(Tables(spark, d).documents)


@register("op8_simhash_pivots")
def op8(spark, d):
    return simhash.near_duplicates(Tables(spark, d).documents)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


@register("op9_toxicity")
def op9(spark, d):
    t = Tables(spark, d)
    machine = toxicity.fit(t.documents, t.labels.where(~held_out()))
    return toxicity.toxicity_scores(t.documents, machine).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


_HEX_GROUPS = "list_transform(range(8), lambda g: ('0x' || substr(x, (5 * g + 1)::INT, 5))::BIGINT)"
OP10_SQL = f"""
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
coded AS (SELECT page_id, payload_bytes, list_aggregate(flatten(list_transform({_HEX_GROUPS}, lambda n: list_transform(range(4), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> (15 - 5 * k)::INT) & 31)::INT + 1, 1)))), 'string_agg', '') AS payload_digest FROM hashed),
last AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM last"""


@register("op10_warc", OP10_SQL)
def op10(spark, d):
    path = warc.write_warc(Tables(spark, d).pages, stage_path(spark, "warc"))
    kept = warc.read_warc(spark, path, payloads=False).where("kind = 'record'")
    return kept.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


OP11_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
facts AS (
  SELECT *, regexp_extract_all(text, '{_WORD}') AS ws, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, regexp_matches(text, '[#$%&*|]') AS marked,
    min(doc_id) OVER (PARTITION BY text) AS least FROM docs),
masks AS (
  SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * list_unique(ws) < 50 * len(ws))::INT + 4 * (100 * capitals > 2 * length(text))::INT + 8 * marked::INT
    + 16 * coalesce(doc_id > least, false)::INT AS mask FROM facts),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM masks LEFT JOIN marks USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM f p, f q, f r, f s, f t
  WHERE len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
rows AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM rows"""


@register("op11_filter_audit", OP11_SQL)
def op11(spark, d):
    t = Tables(spark, d)
    return audit.filter_audit(t.documents, t.labels)


_LOOPED = f"regexp_extract_all(coalesce(text, ''), '{_WORD}', 0)".replace(chr(92), chr(92) * 2)


def looped(docs):
    """One text in ten, by the id's crc32, with its words from some place on replaced by a loop."""
    words, tail = F.expr(_LOOPED), F.expr("n - a")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    sized = chosen.select("*", F.size("w").alias("n")).select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a"))
    timed = sized.select("*", (1 + F.floor(tail / (3 + F.col("g") % 8))).cast("int").alias("p"))
    loop = F.flatten(F.array_repeat(F.slice("w", (F.col("a") + 1).cast("int"), F.col("p")), F.ceil(tail / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.slice(loop, F.lit(1), tail.cast("int"))), " ")
    return timed.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


OP12_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
coded AS (
  SELECT rid, doc_id, ws, len(ws) AS n, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(8 * length(doc_id::VARCHAR)), lambda k: (ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1)) >> (k % 8)::INT & 1)::UBIGINT)),
    lambda c, b: CASE WHEN xor(c & 1, b) = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM docs),
picked AS (SELECT *, xor(c, 4294967295::UBIGINT)::BIGINT AS h FROM coded),
placed AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM picked),
timed AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
texts AS (SELECT rid, doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1)::INT]) END AS ws FROM timed),
tok AS (SELECT rid, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM texts),
pairs AS (SELECT x.rid, y.i - x.i AS q, x.i FROM tok x JOIN tok y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
marked AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs),
runs AS (SELECT rid, q, min(i) AS s, count(*) + q AS len FROM marked GROUP BY rid, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
least AS (SELECT * FROM runs r WHERE NOT EXISTS (FROM runs o WHERE o.rid = r.rid AND o.q < r.q AND o.s <= r.s AND o.s + o.len >= r.s + r.len)),
joined AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM least GROUP BY rid),
best AS (SELECT * FROM least r WHERE NOT EXISTS (FROM least o WHERE o.rid = r.rid AND (o.len * r.q > r.len * o.q OR o.len * r.q = r.len * o.q AND (o.s < r.s OR o.s = r.s AND o.q < r.q)))),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM least),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM tok ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period, (1000 * len // q)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM docs LEFT JOIN joined USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)"""


def _sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


@register("op12_periodic_runs", OP12_SQL)
def op12(spark, d):
    found = runs.find_runs(looped(Tables(spark, d).documents), digest=_sha256).withColumn("best", runs.strongest_run())
    listed = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, char(10))))")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.lower(F.hex("collapsed")).alias("collapsed_sha256"),
    )


OP13_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
tok AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM docs),
win AS (SELECT rid, doc_id, i, array_to_string(ws[i + 1:i + 20], ' ') AS w FROM (SELECT rid, doc_id, ws, unnest(range(len(ws) - 19)) AS i FROM docs)),
judged AS (SELECT rid, i, row(coalesce(doc_id, 9223372036854775807), i) > min(row(coalesce(doc_id, 9223372036854775807), i)) OVER (PARTITION BY w) AS later FROM win),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS i FROM judged WHERE later),
removed AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM tok ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN removed USING (rid) LEFT JOIN kept USING (rid)"""


@register("op13_substring_dedup", OP13_SQL)
def op13(spark, d):
    left = substrings.drop_repeated_passages(Tables(spark, d).documents, digest=_sha256)
    return left.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))
