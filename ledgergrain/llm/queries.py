"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from ledgergrain.llm import bpe, decontaminate, kd_shards, merkle, mixing, ngram_join, periodic_runs, quality_rules
from ledgergrain.llm import substring_dedup, suffix_dedup, topk, toxicity, weak_quality


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules.judged(docs, quality_rules.Cascade.fit(docs)).drop("text")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


#: Weights of the mix: by domain, and by language in every domain; sources are equal. Domains are the source number
#: modulo four.
MIX_DOMAINS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}
MIX_LANGUAGES = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
MIX_SHARE, MIX_EPOCHS = 0.8, 3


def mix(docs: DataFrame) -> DataFrame:
    number = F.coalesce(F.try_to_number(F.regexp_extract("source", r"(\d{1,9})", 1), F.lit("999999999")), F.lit(0))
    levels = {
        "domain": F.concat(F.lit("d"), (number.cast("int") % 4).cast("string")),
        "lang": F.col("lang"),
        "source": F.col("source"),
    }
    weights = {(d,): w for d, w in MIX_DOMAINS.items()}
    weights |= {(d, x): w for d in MIX_DOMAINS for x, w in MIX_LANGUAGES.items()}
    return mixing.mixed(docs, levels, weights, MIX_SHARE, MIX_EPOCHS)


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "domain", "lang", "source", "epoch", "n_words")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.joined(table(spark, folder, "documents"))


def op6_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    return kd_shards.shards(table(spark, folder, "documents"))


def op7_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", *suffix_dedup.COUNTS, F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(docs, path, pattern).select("doc_id", "n_tokens", "token_ids")
    return bpe.decode(ids, path).select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("token_ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op10_weak_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return weak_quality.scored(docs, weak_quality.fit(docs)).select("doc_id", "score", "kept")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth text, by a checksum of its id, with its words from some place on in a cycle."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    n = F.greatest(F.size("w"), F.lit(1))
    p = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    chosen = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("w"))
    placed = chosen.withColumn("a", (F.col("g") % n).cast("int")).withColumn("p", p)
    cycle = F.slice("w", F.col("a") + 1, F.col("p"))
    turns = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(cycle, turns)), F.lit(1), n - F.col("a"))
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return placed.select("doc_id", F.when(F.size("w") > 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_planted_runs(table(spark, folder, "documents").select("doc_id", "text"))
    found = periodic_runs.find(docs).select("doc_id", "runs", "collapsed")
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # Runs come by start and period, so of equal exponents the first stays.
    best = F.aggregate(
        "runs", F.get("runs", F.lit(0)),
        lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a),
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.find(docs, table(spark, folder, "benchmark")).drop("text")


MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(*MANIFEST_FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lower = F.translate("text", decontaminate.UPPER, decontaminate.LOWER)
    text = merkle.encoded(F.when(tampered, lower).otherwise(F.col("text")))
    claim = merkle.digest(*[merkle.encoded(F.col(f)) for f in MANIFEST_FIELDS[:-1]], text)
    return merkle.proved(merkle.build(docs, MANIFEST_FIELDS, "source", "doc_id", ["doc_id"], claim))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_join": op5_ngram_join,
    "op6_kd_shards": op6_kd_shards,
    "op7_exact_topk": op7_exact_topk,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_weak_quality": op10_weak_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_decontamination": op12_decontamination,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Words of each text as a list; a text without words gives an empty list.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
pos AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
win AS (SELECT r, i, w[i:i + 7] AS s FROM pos),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(8) AS o(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^a-z]', '', 'g')) AS low,
  length(regexp_replace(text, '[^!]', '', 'g')) AS ex,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS same
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 15 * n_words OR 100 * up > 60 * (up + low) OR 100 * ex > 50 * n_words
       OR 100 * same > 20 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""

_OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
pos AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM pos),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i FROM win SEMI JOIN rep USING (h)),
cov AS (SELECT r, list(DISTINCT i + k) AS gone FROM hit, range(35) AS o(k) GROUP BY r),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
gone AS (SELECT r, unnest(gone) AS i FROM cov),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN cov USING (r) LEFT JOIN kept USING (r)
"""

_OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
  list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP5 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, s FROM (
  SELECT r, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
pair AS (SELECT x.r AS a, y.r AS b, count(*) AS o FROM g x JOIN g y ON x.s = y.s AND x.r <> y.r GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * o >= 80 * (p.n + q.n - o)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
c AS (SELECT reach.a AS r, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.r = reach.b GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""

#: Texts as hexadecimal digits, two a byte.
_OP8 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
pos AS (SELECT r, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM d WHERE length(x) >= 800),
win AS (SELECT r, i, md5_number(x[2 * i + 1:2 * i + 800]) AS h FROM pos),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i FROM win SEMI JOIN rep USING (h)),
cut AS (SELECT r, i, coalesce(i > 400 + lag(i) OVER (PARTITION BY r ORDER BY i), true) AS new FROM hit),
runs AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM cut),
span AS (SELECT r, k, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY r, k),
edge AS (SELECT r, b AS a, lead(a) OVER (PARTITION BY r ORDER BY k) AS b FROM span
         UNION ALL SELECT r, 0, min(a) FROM span GROUP BY r),
kept AS (SELECT r, string_agg(CASE WHEN b IS NULL THEN x[2 * a + 1:] ELSE x[2 * a + 1:2 * b] END, '' ORDER BY a) AS x
         FROM edge JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, sum(b - a)::BIGINT AS n, count(*) AS k FROM span GROUP BY r)
SELECT doc_id, length(d.x) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(k, 0) AS n_spans,
  sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN sums USING (r)
"""

#: CRC-32 of the decimal id, bit by bit: each character enters with the first of its eight steps.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
    "lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), "
    "lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
)

_OP11 = rf"""
WITH h AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} AS h, {_WORDS} AS w FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
  THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
word AS (SELECT r, unnest(w) AS x, unnest(range(n)) AS i FROM d),
q AS (SELECT r, n, unnest(range(1, n // 4 + 1)) AS q FROM d),
k AS (SELECT r, q, unnest(range((n - 1) // q)) AS k FROM q),
same AS (SELECT k.r, q, k FROM k JOIN word a ON a.r = k.r AND a.i = k * q JOIN word b ON b.r = k.r AND b.i = k * q + q
         WHERE a.x = b.x),
hope AS (SELECT DISTINCT x.r, x.q FROM same x JOIN same y ON y.r = x.r AND y.q = x.q AND y.k = x.k + 1
         JOIN same z ON z.r = x.r AND z.q = x.q AND z.k = x.k + 2),
cut AS (SELECT hope.r, q, a.i FROM hope JOIN word a ON a.r = hope.r JOIN word b ON b.r = a.r AND b.i = a.i + q
        WHERE a.x <> b.x UNION ALL SELECT r, q, -1 FROM hope
        UNION ALL SELECT hope.r, q, n - q FROM hope JOIN d ON d.r = hope.r),
gap AS (SELECT r, q, lag(i) OVER (PARTITION BY r, q ORDER BY i) + 1 AS start, i AS stop FROM cut),
run AS (SELECT r, start, stop - start + q AS length, min(q) AS period FROM gap
        WHERE stop - start + q >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1),
list AS (SELECT r, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t
         FROM run GROUP BY r)
SELECT doc_id, coalesce(list.n, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(list.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN list USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all(coalesce({_LOW}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_TERMS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (
  SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT r, i, n, item FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM pos) JOIN win USING (n, s)),
cov AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(range(i, i + n)) AS i FROM hit) GROUP BY r),
who AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(cov.n, 0) AS n_hit, coalesce(who.n, 0) AS n_items,
  sha256(coalesce(who.t, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN who USING (r)
"""


def _coded(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


#: Levels of nodes upwards from ``leaf`` (t, i, h), as long as a tree has several nodes.
_LEVELS = """{up} AS (SELECT t, 0 AS l, i, h FROM {leaf} UNION ALL
  SELECT t, l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (
    SELECT *, max(i) OVER (PARTITION BY t) AS m FROM {up}) WHERE m > 0 GROUP BY t, l, i // 16)"""
#: The siblings of each leaf (t, i) by level, with which of them stand left.
_SIBLINGS = """SELECT leaf.t, leaf.i, l, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < (leaf.i >> (4 * l))), '') AS a,
  coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > (leaf.i >> (4 * l))), '') AS b
  FROM {leaf} leaf JOIN {up} u ON u.t = leaf.t AND (u.i >> 4) = (leaf.i >> (4 * u.l + 4))
  JOIN (SELECT t, max(l) AS top FROM {up} GROUP BY t) m ON m.t = u.t WHERE l < top GROUP BY 1, 2, 3"""

_OP13 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source,
  sha256({" || ".join(map(_coded, MANIFEST_FIELDS))}) AS h, sha256({" || ".join(map(_coded, MANIFEST_FIELDS[:-1]))} || {
    _coded(f"CASE WHEN {_CRC} % 5 = 0 THEN {_LOW} ELSE text END")
}) AS claim FROM documents),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT source FROM d)),
leaf AS (SELECT r, doc_id, claim, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS i, h
         FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source),
{_LEVELS.format(up="up", leaf="leaf")},
sub AS (SELECT 0 AS t, t AS i, arg_max(h, l) AS h FROM up GROUP BY up.t),
{_LEVELS.format(up="top", leaf="sub")},
near AS ({_SIBLINGS.format(leaf="leaf", up="up")}),
far AS ({_SIBLINGS.format(leaf="sub", up="top")}),
path AS (SELECT t, i, 0 AS part, l, a, b FROM near
         UNION ALL SELECT leaf.t, leaf.i, 1, l, a, b FROM leaf JOIN far ON far.i = leaf.t),
way AS (SELECT t, i, string_agg(a || b, '' ORDER BY part, l) AS every, list(a || '|' || b ORDER BY part, l) AS steps
        FROM path GROUP BY t, i),
root AS (SELECT arg_max(h, l) AS root FROM top),
f AS (SELECT doc_id, leaf.h AS leaf, sub.h AS subroot, root, sha256(coalesce(every, '')) AS proof_sha256,
  list_reduce(list_prepend(claim, coalesce(steps, [])),
    lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM leaf JOIN sub ON sub.i = leaf.t LEFT JOIN way ON way.t = leaf.t AND way.i = leaf.i, root)
SELECT *, folded_root = root AS verified FROM f
"""

ORACLES = {
    "op5_ngram_join": _OP5,
    "op8_suffix_dedup": _OP8,
    "op7_exact_topk": _OP7,
    "op1_quality_rules": _OP1,
    "op2_substring_dedup": _OP2,
    "op11_periodic_runs": _OP11,
    "op12_decontamination": _OP12,
    "op13_merkle_manifest": _OP13,
}
