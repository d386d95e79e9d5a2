"""The registered queries of the numbered operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackside.llm.audit_repair import repaired
from trackside.llm.common import prepare
from trackside.llm.hard_negatives import EVERY as EVERY_ANCHOR
from trackside.llm.hard_negatives import mined
from trackside.llm.imatch import fingerprinted
from trackside.llm.nbsvm import quality
from trackside.llm.packing import packed
from trackside.llm.pieces import digests, in_pieces
from trackside.llm.rabitq import EVERY, search
from trackside.llm.sanitise import personal_data
from trackside.llm.signature_join import near_duplicates
from trackside.llm.source_mix import ORACLE as MIX_ORACLE
from trackside.llm.source_mix import mixed
from trackside.llm.substring_windows import remove_repeated_windows
from trackside.llm.suffix_repeats import remove_repeated_strings
from trackside.llm.warc import archived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WINDOWS_ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), marked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS nth FROM windows
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM marked WHERE nth > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY words.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query(WINDOWS_ORACLE)
def op9_countmin_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents")).drop("kept_text")


STRINGS_ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
gone AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
runs AS (SELECT *, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, -1) AS opens FROM gone),
numbered AS (SELECT doc_id, i, count_if(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM runs),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM numbered GROUP BY ALL),
cut AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM spans),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS h,
    count(*) AS n_spans, sum(z - a) AS n_removed
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query(STRINGS_ORACLE)
def op10_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_strings(table(spark, sf_dir, "documents")).drop("kept")


JOIN_ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT x AS doc_id, x AS r FROM both_ways
  UNION
  SELECT reached.doc_id, y FROM reached JOIN both_ways ON x = r
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(min(r), d.doc_id) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN reached USING (doc_id) GROUP BY d.doc_id, n
"""


@query(JOIN_ORACLE)
def op5_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op2_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(MIX_ORACLE)
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@query()
def op3_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@query()
def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))


WARC_ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
h AS (SELECT *, sha1(payload) AS hex FROM f)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
  -- base32: 8 letters for every 10 hexadecimal digits
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""


@query(WARC_ORACLE)
def op6_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


SEARCH_ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query(SEARCH_ORACLE)
def op1_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)


@query()
def op13_aligned_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(in_pieces(table(spark, sf_dir, "documents")))


NEGATIVES_ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query(NEGATIVES_ORACLE)
def op12_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % EVERY_ANCHOR == 0)


REPAIR_ORACLE = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
), h AS (
  SELECT *, xor(list_reduce(
    -- CRC-32 bit by bit: after each byte of the key eight shifts
    list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(key) + 1),
      lambda i: list_prepend(ascii(key[i])::BIGINT, list_transform(range(8), lambda j: -1::BIGINT))))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS damage
  FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN damage = 3 THEN 2 ELSE 1 END)) AS copy
  FROM h WHERE damage <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
  FROM o
), r AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM n
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count_if(fault = 'blank')::BIGINT AS blank, count_if(fault = 'duplicate')::BIGINT AS duplicate,
    count_if(fault = 'truncated')::BIGINT AS truncated, count_if(pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS last
  FROM r GROUP BY conv_id
), ins(s, t, a, c, l) AS (
  VALUES (0, 0, '', 0, []), (0, 2, 'I', 2, ['user:']), (0, 3, 'II', 4, ['user:', 'assistant:']),
    (1, 1, '', 0, []), (1, 2, 'I', 2, ['user:']), (1, 3, 'II', 4, ['user:', 'assistant:']),
    (2, 2, '', 0, []), (2, 3, 'I', 2, ['assistant:']), (3, 3, '', 0, []), (3, 2, 'I', 2, ['user:'])
), act(t, e, to_s, initial, role, c) AS (
  VALUES (0, 'D', 0, NULL, NULL, 3), (1, 'D', 1, NULL, NULL, 3), (2, 'D', 2, NULL, NULL, 3), (3, 'D', 3, NULL, NULL, 3),
    (0, 'K', 1, 's', NULL, 0), (0, 'K', 2, 'u', NULL, 0), (1, 'K', 2, 'u', NULL, 0), (2, 'K', 3, 'a', NULL, 0), (3, 'K', 2, 'u', NULL, 0),
    (0, 'R', 2, NULL, 'user', 2), (1, 'R', 2, NULL, 'user', 2), (2, 'R', 3, NULL, 'assistant', 2), (3, 'R', 2, NULL, 'user', 2)
), best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, {'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]} AS b FROM counted
  UNION ALL
  SELECT best.conv_id, r.i, act.to_s, min({
    'c': (b.c + ins.c + act.c + CASE WHEN fault = 'truncated' AND e <> 'D' THEN 1 ELSE 0 END)::BIGINT,
    'a': b.a || ins.a || e,
    'l': list_concat(b.l, ins.l, CASE e WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [act.role || ':' || r.text] END)})
  FROM best JOIN r ON r.conv_id IS NOT DISTINCT FROM best.conv_id AND r.i = best.i + 1
    JOIN ins ON ins.s = best.s JOIN act ON act.t = ins.t
  WHERE (e = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (initial IS NULL OR initial = r.role[1])
  GROUP BY best.conv_id, r.i, act.to_s
), ended AS (
  SELECT best.conv_id, min({'c': (b.c + ins.c)::BIGINT, 'a': b.a || ins.a, 'l': list_concat(b.l, ins.l)}) AS b
  FROM best JOIN counted ON counted.conv_id IS NOT DISTINCT FROM best.conv_id AND best.i = last
    JOIN ins ON ins.s = best.s AND ins.t IN (0, 3)
  GROUP BY best.conv_id
)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
  coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
  LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations as the contract spoils them; null values are one space."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.withColumn("damage", F.crc32(F.concat_ws(":", either("conv_id"), either("turn")).cast("binary")) % 20)
    rows = rows.where("damage <> 0").withColumns({"role": either("role"), "text": either("text")})
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))})
    copies = F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy")).drop("copy")


@query(REPAIR_ORACLE)
def op11_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repaired(damaged(turns), turns.select("conv_id"))
