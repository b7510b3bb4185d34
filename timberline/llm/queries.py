"""One query for each corpus operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import dealt


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A whole table; one of fewer files than cores is dealt out to all cores if it is small."""
    return dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    from . import bpe

    return bpe.digests(_read(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_ledger

    done = line_ledger.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), threshold=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shards

    return shards.shard_by_bytes(_read(spark, sf_dir, "documents"), 16)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_rtree

    return jaccard_rtree.join(_read(spark, sf_dir, "documents"), n=4, percent=85)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tiling

    return tiling.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify(_read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    # Two waves: the base rules, and again with more rules, for which the ledger runs the new ones only.
    ledger, docs = secrets.BlobLedger(spark), _read(spark, sf_dir, "documents")
    ledger.scan(docs)
    found = ledger.scan(docs, (*secrets.BASE_RULES, *secrets.MORE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in secrets.BASE_RULES]))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    turns = chat.with_probe(spark, _read(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_conversations(turns))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.round_trip(_read(spark, sf_dir, "pages"), least=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import impact_index

    rows = _read(spark, sf_dir, "embeddings")
    return impact_index.top_k(rows, rows.where("vec_id % 50 = 0"), 5)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_shards": op4_shards,
    "op5_topk": op5_topk,
    "op6_jaccard": op6_jaccard,
    "op7_decontamination": op7_decontamination,
    "op8_langid": op8_langid,
    "op9_secrets": op9_secrets,
    "op10_chat": op10_chat,
}

_OP2 = r"""
WITH lines AS (
  SELECT doc_id, i, list_extract(parts, i) AS line,
         translate(trim(list_extract(parts, i), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
hot AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN hot ON lines.k = hot.k GROUP BY doc_id
"""


_OP9_RULES = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": "eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+",
    "login": r"[a-z]+://[A-Za-z0-9._-]+:([^@/\s]+)@",
}
_OP9_LEAST = {"assign": (2, 8), "access": (0, 16), "hex": (0, 32), "key": (0, 1), "jwt": (0, 1), "login": (1, 4)}


def _op9_kind(rank: int, kind: str) -> str:
    pattern = _OP9_RULES[kind].replace("'", "''")
    group, least = _OP9_LEAST[kind]
    return f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + n AS stop FROM (
      SELECT doc_id, i, n, own,
             sum(gap + n) OVER (PARTITION BY doc_id ORDER BY i) - n AS start
      FROM (SELECT doc_id, i, length(list_extract(gaps, i)) AS gap, length(list_extract(hits, i)) AS n, length(list_extract(owns, i)) AS own
            FROM (SELECT doc_id, gaps, hits, owns, unnest(range(1, len(hits) + 1)) AS i
                  FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS hits,
                               regexp_extract_all(text, '{pattern}', {group}) AS owns
                        FROM documents WHERE regexp_matches(text, '{pattern}')))))
    WHERE own >= {least}"""


_OP9 = (
    "WITH spans AS (" + " UNION ALL ".join(_op9_kind(i, k) for i, k in enumerate(_OP9_RULES)) + """),
held AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS b, count(*) FILTER (WHERE kind = 'hex') AS c,
                string_agg(shown, ',' ORDER BY start, rank) AS s, string_agg(shown, ',' ORDER BY start, rank) FILTER (WHERE kind IN ('assign', 'access', 'hex')) AS base
         FROM (SELECT *, kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) AS shown FROM spans) GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(s, '') AS spans
FROM documents d LEFT JOIN held h ON d.doc_id = h.doc_id"""
)

_OP10 = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

_OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, strlen(body) AS n, max(page_id) OVER (PARTITION BY body) AS top, unhex(sha1(body))::BIT::VARCHAR AS bits FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
            + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""

_OP4 = """
WITH RECURSIVE
entry(n, c, k) AS (SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM entry WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM entry WHERE k = 8),
hexed AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, size), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
           lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295::BIGINT) AS crc
  FROM hexed, crc_table),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, crc, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM summed),
cut AS (SELECT *, ((start * 16) // total)::INTEGER AS shard FROM placed)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, crc, size) - 1 AS slot, NULL::INTEGER AS grown_shard FROM cut
"""

_OP6 = r"""
WITH RECURSIVE
split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.low FROM reach r JOIN edges e ON r.node = e.x WHERE r.low < e.y)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, (SELECT min(low) FROM reach WHERE node = d.doc_id) AS component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

ORACLES = {"op4_shards": _OP4, "op6_jaccard": _OP6, "op3_warc": _OP3, "op5_topk": _OP5, "op2_line_dedup": _OP2, "op9_secrets": _OP9, "op10_chat": _OP10}
