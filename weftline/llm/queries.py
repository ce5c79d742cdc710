"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat, decontam, fim, licenses, lines, near_dup, packing, pii, quality, repeats, replay, sharding, topk

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file(), size=2048, end=0)


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))



@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10, gram=5))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), threshold=0.3)
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op9_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLE_SQL["op9_top_k_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir, "documents"), span=50).drop("removed")


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(table(spark, sf_dir, "documents"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_matches(table(spark, sf_dir, "documents"), percent=80)


ORACLE_SQL["op6_line_dedup"] = """
WITH line AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), one AS (
  SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM line
), worded AS (
  SELECT doc_id, pos, list_sort(list_distinct(list_filter(string_split(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    '), ' '), lambda x: x <> ''))) AS w
  FROM one
), full_line AS (SELECT * FROM worded WHERE len(w) > 0),
firsts AS (
  SELECT w, min({'d': doc_id, 'p': pos}) AS f, len(w) AS t, row_number() OVER () AS k FROM full_line GROUP BY w
), token AS (SELECT k, t, f, unnest(w) AS x FROM firsts WHERE t >= 4),
pair AS (
  SELECT a.k AS k FROM token a JOIN token b ON a.x = b.x AND b.f < a.f AND 100 * least(a.t, b.t) >= 80 * greatest(a.t, b.t)
  GROUP BY a.k, b.k, a.t, b.t HAVING 100 * count(*) >= 80 * (a.t + b.t - count(*))
), near AS (SELECT DISTINCT k FROM pair),
gone AS (
  SELECT l.doc_id, l.pos, (l.doc_id <> f.f.d OR l.pos <> f.f.p) AS again
  FROM full_line l JOIN firsts f ON l.w = f.w
  WHERE l.doc_id <> f.f.d OR l.pos <> f.f.p OR f.k IN (SELECT k FROM near)
), summed AS (
  SELECT doc_id, count(*) FILTER (again) AS n_exact, count(*) FILTER (NOT again) AS n_near, list(CAST(pos AS INTEGER) ORDER BY pos) AS removed FROM gone GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(l.parts) AS BIGINT) AS n_lines, coalesce(s.n_exact, 0) AS n_exact, coalesce(s.n_near, 0) AS n_near,
       coalesce(s.removed, CAST([] AS INTEGER[])) AS removed
FROM line l LEFT JOIN summed s USING (doc_id)
"""


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restored(fim.fill_in_middle(table(spark, sf_dir, "documents"), seed=1, apply_percent=90, spm_percent=20))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_DRAW = "CAST(CAST('0x' || substr(h, {0}, 8) AS UBIGINT) AS BIGINT)"
ORACLE_SQL["op11_fill_in_middle"] = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, {", ".join(f"{_DRAW.format(8 * i + 1)} AS h{i + 1}" for i in range(4))} FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


#: Both rows of it say what is a control string of the template.
_CONTROLS = "(SELECT CAST(-7 AS BIGINT) AS conv_id, 0 AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')"


@query
def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    messages = given.union(spark.sql(_CONTROLS[1:-1])).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.digests(chat.formatted(messages))


_ESCAPE = r"regexp_replace({0}, '([\[<])(\\*)(/?(?:SYS|INST|ROLE|TURN|IMAGE|AUDIO|DOCUMENT|FILE)\]|/?s>)', '\1\\\2\3', 'g')"
_MARKED = f"CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + length({_ESCAPE.format('role')}) END"
ORACLE_SQL["op12_chat_formatting"] = f"""
WITH message AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM {_CONTROLS} c) m
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESCAPE.format('text')}) + {_MARKED}) AS BIGINT) AS formatted_chars
FROM message GROUP BY conv_id
"""


@query
def op13_quarantine_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replayed(table(spark, sf_dir, "conversations"))


#: CRC-32 for DuckDB, which has none: the table of 256 remainders, and a fold of a text's bytes over it.
_REMAINDERS = "CAST(range(256) AS BIGINT[])"
for _ in range(8):
    _REMAINDERS = f"list_transform({_REMAINDERS}, lambda x: CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)"
_REMAINDERS = f"crc_table AS (SELECT {_REMAINDERS} AS remainders)"


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text as UTF-8; crc_table has to be among the tables."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    ones = "CAST(4294967295 AS BIGINT)"
    return f"xor(list_reduce({data}, lambda a, b: xor(a >> 8, remainders[xor(a & 255, b) + 1]), {ones}), {ones})"


ORACLE_SQL["op3_sharding"] = f"""
WITH {_REMAINDERS}, sized AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM sized
), dealt AS (SELECT *, CAST(((2 * start + size) * 16) // (2 * total) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt
"""

_WAITS = (0, 20, 60, 140, 300, 620)
_DELIVERS = "CASE WHEN NOT faulty THEN 1 " + " ".join(f"WHEN start + {wait} >= repair AND h[{a + 3}] % 3 <> 0 THEN {a}" for a, wait in enumerate(_WAITS, 1)) + " END"
ORACLE_SQL["op13_quarantine_release"] = f"""
WITH RECURSIVE {_REMAINDERS}, numbered AS (
  SELECT conv_id, turn, crc, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, crc) - 1 AS p
  FROM (SELECT conv_id, turn, role, {_crc32("coalesce(text, '')")} AS crc FROM conversations, crc_table) c
), asked AS (
  SELECT conv_id, turn, crc, p, k, {_crc32("k || ':' || coalesce(CAST(conv_id AS VARCHAR), '') || ':' || coalesce(CAST(turn AS VARCHAR), '')")} AS h FROM (SELECT *, unnest(range(9)) AS k FROM numbered) a, crc_table
), drawn AS (
  SELECT conv_id, turn, crc, p, h, CASE WHEN h[1] % 5 BETWEEN 1 AND p THEN h[1] % 5 END AS back, h[2] % 101 < 50 AS faulty, 7 * p + h[3] % 101 AS repair
  FROM (SELECT conv_id, p, any_value(turn) AS turn, any_value(crc) AS crc, list(h ORDER BY k) AS h FROM asked GROUP BY conv_id, p) d
), replayed AS (
  SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) AS p, CAST(NULL AS INTEGER) AS turn, CAST(0 AS BIGINT) AS crc, '' AS status, 0 AS attempts, CAST(NULL AS BIGINT) AS first_at, CAST(NULL AS BIGINT) AS last_at, ['', '', '', ''] AS statuses, CAST([0, 0, 0, 0] AS BIGINT[]) AS lasts FROM numbered
  UNION ALL
  SELECT conv_id, p, turn, crc, status, attempts, first_at, last_at, list_prepend(status, statuses[1:3]), list_prepend(last_at, lasts[1:3]) FROM (
    SELECT *, CASE WHEN blocked THEN 'blocked' WHEN nth IS NULL THEN 'dead' ELSE 'delivered' END AS status, CAST(CASE WHEN blocked THEN 0 ELSE coalesce(nth, 6) END AS INTEGER) AS attempts,
           CASE WHEN NOT blocked THEN start END AS first_at, CASE WHEN NOT blocked THEN start + [{", ".join(map(str, _WAITS))}][coalesce(nth, 6)] END AS last_at FROM (
      SELECT *, {_DELIVERS} AS nth FROM (
        SELECT d.*, r.statuses, r.lasts, back IS NOT NULL AND r.statuses[back] <> 'delivered' AS blocked, greatest(7 * d.p, coalesce(r.lasts[back], 0)) AS start
        FROM replayed r JOIN drawn d ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND d.p = r.p + 1) s) n) o
), released AS (
  SELECT conv_id, p, row_number() OVER w AS release_no, crc, last_at, turn FROM replayed WHERE status = 'delivered' WINDOW w AS (PARTITION BY conv_id ORDER BY last_at, turn NULLS FIRST, p)
), summed AS (SELECT conv_id, p, release_no, CAST(sum(release_no * crc) OVER (PARTITION BY conv_id ORDER BY release_no) AS BIGINT) AS state FROM released)
SELECT t.conv_id, t.turn, t.status, t.attempts, t.first_at, t.last_at, s.release_no, s.state
FROM replayed t LEFT JOIN summed s ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.p = t.p WHERE t.p >= 0
"""


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ORACLE_SQL["op1_minhash_near_dedup"] = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all({_lower('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingle AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS s FROM worded
), sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sized m ON m.doc_id = x.doc_id JOIN sized n ON n.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, m.n, n.n HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))
), reached AS (SELECT a AS doc_id, b AS other FROM link UNION SELECT r.doc_id, l.b FROM reached r JOIN link l ON r.other = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.other), w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(min(r.other), w.doc_id)) AS kept
FROM worded w LEFT JOIN sized n ON n.doc_id = w.doc_id LEFT JOIN reached r ON r.doc_id = w.doc_id GROUP BY w.doc_id
"""

ORACLE_SQL["op10_benchmark_decontamination"] = f"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_lower('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lower('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), item_window AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0) t
), doc_window AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM item_window) s WHERE len(w) >= k) t
), hit AS (SELECT d.r, d.i, d.k, b.item FROM doc_window d JOIN item_window b ON d.k = b.k AND d.win = b.win),
place AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) t GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n, sha256(array_to_string(list_sort(list_distinct(list(item))), ',')) AS digest FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, coalesce(m.digest, sha256('')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN place p ON p.r = d.r LEFT JOIN named m ON m.r = d.r
"""
