"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontam, embeddings, langid, lm, mixing, packing, phrases, pii, quality, sharding, simhash, tokenout
from .common import durable, held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontam.items_digest().alias("items_sha256"), "contaminated")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP2_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_OP2_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_OP2_WORDS} AS w FROM benchmark),
b2 AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b2)),
grams AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, i, grams.n AS n, item_id FROM grams JOIN win ON grams.n = win.n AND grams.k = win.k),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
           FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN who USING (doc_id)
"""


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id", 3, 1)
    model = langid.fit(docs.where(~held))
    found = langid.identify(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))



def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [pii.count_kind("base_spans", k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.as_text(F.col("base_spans")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def _op6_kind(kind: pii.Kind) -> str:
    """CTE of the confirmed spans of one kind: doc_id, kind, start, end, context before."""
    pattern = pii.BASE_PATTERNS.get(kind.name, kind.pattern).replace("'", "''")
    number = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = "(list_sum([CASE WHEN i % 2 = 0 THEN CASE WHEN d > 4 THEN d * 2 - 9 ELSE d * 2 END ELSE d END FOR d, i IN [CAST(x AS INTEGER) FOR x IN string_split(reverse(digits), '')]]) % 10 = 0)"
    good = {
        "email": "true",
        "ip": "list_bool_and([len(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) <= 255 FOR p IN string_split(m, '.')])",
        "card": f"len({number}) BETWEEN 13 AND 19 AND CASE WHEN len({number}) BETWEEN 13 AND 19 THEN {luhn.replace('digits', number)} ELSE false END",
        "phone": f"len({number}) BETWEEN 9 AND 15",
        "iban": "len(replace(m, ' ', '')) BETWEEN 15 AND 34 AND CAST(list_aggregate([CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ord(c) - 55 AS VARCHAR) ELSE c END FOR c IN string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4], '')], 'string_agg', '') AS HUGEINT) % 97 = 1",
        "ssn": "NOT regexp_matches(m, '^(?:000|666|9)') AND NOT regexp_matches(m, '-00-') AND NOT regexp_matches(m, '-0000$')",
        "local_phone": "true",
    }[kind.name]
    touch = f"AND NOT regexp_matches(right(l, 1), '{kind.neighbours}') AND NOT regexp_matches(left(r, 1), '{kind.neighbours}')" if kind.neighbours else ""
    near = f"AND {kind.score} + CASE WHEN regexp_matches(lower(substr(text, greatest(s - {pii.NEAR}, 0) + 1, least(s, {pii.NEAR}))), '{kind.context}') OR regexp_matches(lower(substr(text, s + len(m) + 1, {pii.NEAR})), '{kind.context}') THEN 0.5 ELSE 0 END >= 0.5" if kind.name not in pii.BASE else ""
    return f"""{kind.name} AS (
  SELECT doc_id, '{kind.name}' AS kind, s, s + len(m) AS e FROM (
    SELECT doc_id, text, m, l, r, CAST(sum(len(l)) OVER w + coalesce(sum(len(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, text, i, ms[i] AS m, ps[i] AS l, ps[i + 1] AS r FROM (
      SELECT doc_id, text, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS ps FROM documents WHERE regexp_matches(text, '{pattern}'))))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i))
  WHERE {good} {touch} {near})"""


def _op6_sql() -> str:
    names = [k.name for k in pii.KINDS]
    rank = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(names)) + " END"
    base = " UNION ALL ".join(f"SELECT * FROM {k}" for k in pii.BASE)
    added = " UNION ALL ".join(f"SELECT * FROM {k}" for k in names if k not in pii.BASE)
    counts = ", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in pii.BASE)
    sums = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)
    return f"""WITH {", ".join(_op6_kind(k) for k in pii.KINDS)},
base AS ({base}),
whole AS (SELECT * FROM base UNION ALL SELECT * FROM ({added}) a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e)),
b AS (SELECT doc_id, {sums}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {rank}, s) AS t FROM base GROUP BY doc_id),
w AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {rank}, s) AS t FROM whole GROUP BY doc_id)
SELECT doc_id, {counts}, sha256(coalesce(b.t, '')) AS base_sha256, coalesce(w.t, '') AS spans
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN w USING (doc_id)"""



def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 4, 2))
    described = durable(quality.describe(docs, keep=["doc_id", "held_out"]))
    model = quality.fit(described.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return quality.score(described, model)



def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")



def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.withColumn("grown_shard", F.lit(None).cast("int"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each segment of the packed rows that were written: whose it is, its
    row and place in it, and checksums of its ids and position ids as they are stored."""
    rows = tokenout.write(table(spark, sf_dir, "documents"))
    cut = tokenout.documents(rows)
    length = (F.octet_length("ids") / 2).cast("long").alias("length")
    return cut.select("doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "row_id", "segment", "offset", "end", F.crc32("positions").alias("positions_crc32"), "n_tokens")



def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), keep=["vec_id"])



def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7, 2), keep=["doc_id"])


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codes.compress(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return found.withColumn("codebooks_sha256", F.lit(books.digest() if books else ""))


def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """A round is two tables: the nearest entry of each part, and the new entries."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""far{i} AS (SELECT vec_id, c.part, e, sum((c.v - b.v) * (c.v - b.v)) AS d
  FROM comp c JOIN book{i} b ON c.part = b.part AND c.pos = b.pos GROUP BY vec_id, c.part, e),
near{i} AS (SELECT vec_id, part, arg_min(e, row(d, e)) AS e, min(d) AS d FROM far{i} GROUP BY vec_id, part)""")
        if i < rounds:
            steps.append(f"""book{i + 1} AS (SELECT b.part, b.e, b.pos, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN (
  SELECT part, e, pos, CAST(floor_div AS BIGINT) AS v FROM (SELECT n.part, n.e, c.pos,
    (sum(c.v) - ((sum(c.v) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
    FROM near{i} n JOIN comp c ON n.vec_id = c.vec_id AND n.part = c.part GROUP BY n.part, n.e, c.pos)) m
  ON b.part = m.part AND b.e = m.e AND b.pos = m.pos)""")
    return f"""WITH kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL
  AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
flat AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i, len(embedding) // {parts} AS w FROM kept),
comp AS (SELECT vec_id, i // w AS part, i % w AS pos, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM flat),
book0 AS (SELECT part, e, pos, v FROM comp JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id)),
{", ".join(steps)},
digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, e, pos)) AS codebooks_sha256 FROM book{rounds}),
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id) CROSS JOIN digest"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (
  SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m))),
f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
inside AS (SELECT DISTINCT s.lang, s.g FROM f s JOIN f b ON s.lang = b.lang AND b.m > s.m AND b.f >= s.f
  AND contains(' ' || b.g || ' ', ' ' || s.g || ' ')),
cuts AS (SELECT c.lang, c.g, c.f AS a, k, array_to_string(string_split(c.g, ' ')[1:k], ' ') AS lg, array_to_string(string_split(c.g, ' ')[k + 1:], ' ') AS rg
  FROM (SELECT lang, m, g, f, unnest(range(1, m)) AS k FROM f WHERE m > 1) c ANTI JOIN inside USING (lang, g)),
scored AS (SELECT cuts.lang, cuts.g, a, k, x.f AS l, y.f AS r, n,
  CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = lg JOIN f y ON y.lang = cuts.lang AND y.g = rg JOIN totals ON totals.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score FROM best)
WHERE rank <= 2000
"""


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP13_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
  [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
run AS (SELECT *, coalesce(sum(most) OVER earlier, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS open, 1.5::DOUBLE * sum(source_size) OVER () AS share
  FROM w WINDOW earlier AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
full_ones AS (SELECT *, most * open <= weight * (share - filled) AS is_full FROM run),
level AS (SELECT max(share) - coalesce(sum(most) FILTER (is_full), 0) AS rest, sum(weight) FILTER (NOT is_full) AS weights FROM full_ones),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE weight * rest / weights END AS target FROM full_ones CROSS JOIN level),
r AS (SELECT doc_id, size, source_size, target, least(CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END, 2) AS rate,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM r)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""


QUERIES = {"op4_lm_score": op4_lm_score, "op8_vectors": op8_vectors, "op3_shard": op3_shard, "op7_pack": op7_pack, "op9_token_rows": op9_token_rows, "op5_simhash": op5_simhash, "op1_quality": op1_quality, "op6_pii": op6_pii, "op10_language": op10_language, "op2_decontaminate": op2_decontaminate, "op11_vector_codes": op11_vector_codes, "op12_phrases": op12_phrases, "op13_mix": op13_mix}
ORACLES = {"op6_pii": _op6_sql(), "op2_decontaminate": OP2_SQL, "op11_vector_codes": _op11_sql(), "op12_phrases": OP12_SQL, "op13_mix": OP13_SQL}
