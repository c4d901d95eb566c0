"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codicil.llm.bpe import bpe_digests
from codicil.llm.chat import chat_format
from codicil.llm.collocations import collocations
from codicil.llm.exact_dedup import exact_dedup
from codicil.llm.filter_audit import FILTERS, filter_audit
from codicil.llm.mixing import mix
from codicil.llm.near_dedup import near_dedup
from codicil.llm.passages import cut_repeats
from codicil.llm.pii import pii_report
from codicil.llm.quality import quality_rules
from codicil.llm.sharding import shard_by_bytes
from codicil.llm.tokencount import token_counts
from codicil.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op2_cut_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"), digests=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(table(spark, sf_dir, "documents"), trusted)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), whole_text=True)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_cut_repeats": op2_cut_repeats,
    "op3_quality_rules": op3_quality_rules,
    "op4_chat_format": op4_chat_format,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_mix": op7_mix,
    "op8_near_dedup": op8_near_dedup,
    "op9_pii": op9_pii,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_sharding": op11_sharding,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}

OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (
      PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), convs AS (
  SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY place) AS turns,
    string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
  FROM turns GROUP BY conv_id
), firsts AS (
  SELECT turns, n_turns, rendered, min(conv_id) AS conv_id, count(*) AS copies FROM convs GROUP BY turns, n_turns, rendered
), inner_prefixes AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM convs)
)
SELECT conv_id, 0 AS part, n_turns, copies, rendered FROM firsts ANTI JOIN inner_prefixes USING (turns)
"""

OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
), g AS (
  SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY content
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
FROM n JOIN g USING (content)
"""


def _op11_sql(shards: int = 8) -> str:
    """Smallest largest shard by dynamic programming over all cuts, then the evenest cuts it allows."""
    best = "\n".join(
        f"""), m{k} AS MATERIALIZED (
  SELECT b.pos, min(greatest(m.largest, b.pos - m.pos)) AS largest FROM borders b JOIN m{k - 1} m ON m.pos <= b.pos GROUP BY b.pos"""
        for k in range(2, shards + 1)
    )
    earliest = "\n".join(
        f"""), e{k} AS MATERIALIZED (
  SELECT min(b.pos) AS pos FROM borders b, e{k + 1} e, top t WHERE b.pos >= e.pos - t.capacity"""
        for k in range(shards - 1, 0, -1)
    )
    even = "\n".join(
        f"""), p{k} AS MATERIALIZED (
  SELECT least(greatest(c.pos + CAST(ceil((t.total - c.pos) / {shards - k + 1}.0) AS BIGINT), e.pos), c.pos + t.capacity, t.total) AS place,
    c.pos AS begin, t.total, c.pos + t.capacity AS last FROM c{k - 1} c, e{k} e, top t
), c{k} AS MATERIALIZED (
  SELECT arg_min(b.pos, (b.pos = p.begin AND p.begin < p.total, abs(b.pos - p.place), b.pos)) AS pos FROM borders b, p{k} p WHERE b.pos <= p.last
    AND (b.pos = (SELECT max(x.pos) FROM borders x WHERE x.pos <= p.place) OR b.pos = (SELECT min(x.pos) FROM borders x WHERE x.pos >= p.place))"""
        for k in range(1, shards)
    )
    shard = " + ".join(f"CAST(g.ends - g.bytes >= (SELECT pos FROM c{k}) AS INT)" for k in range(1, shards))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size FROM documents
), h AS (
  SELECT text, min(doc_id) AS head, sum(size)::BIGINT AS bytes FROM d GROUP BY text
), g AS MATERIALIZED (
  SELECT text, bytes, sum(bytes) OVER (ORDER BY head NULLS LAST, sha256(text))::BIGINT AS ends FROM h
), borders AS MATERIALIZED (
  SELECT 0::BIGINT AS pos UNION ALL SELECT ends FROM g
), m1 AS MATERIALIZED (
  SELECT pos, pos AS largest FROM borders
{best}
), top AS MATERIALIZED (
  SELECT pos AS total, largest AS capacity FROM m{shards} ORDER BY pos DESC LIMIT 1
), e{shards} AS MATERIALIZED (SELECT total AS pos FROM top
{earliest}
), c0 AS MATERIALIZED (SELECT 0::BIGINT AS pos
{even}
), tbl AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), codes AS (
  SELECT text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM h
), crcs AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM codes, tbl
), placed AS (
  SELECT d.doc_id, d.text, d.size, c.crc, {shard} AS shard FROM d JOIN g USING (text) JOIN crcs c USING (text)
), byte_rows AS (
  SELECT doc_id, size, crc, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, sha256(text)) - 1 AS slot FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, slot, CAST(NULL AS INT) AS grown_shard FROM byte_rows
"""


def _op12_sql(least: int = 100, most: int = 2000, covered: int = 100) -> str:
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda w: w <> '') AS w FROM pieces
), begins AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), runs AS (
  SELECT lang, w[i : i + k - 1] AS phrase FROM (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM begins)
), f AS MATERIALIZED (
  SELECT lang, phrase, count(*) AS f FROM runs GROUP BY lang, phrase HAVING count(*) >= {least}
), totals AS (
  SELECT lang, count(*) AS n FROM begins GROUP BY lang
), cuts AS (
  SELECT lang, phrase, f AS a, unnest(range(1, len(phrase))) AS k FROM f WHERE len(phrase) > 1
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.phrase[1 : c.k]
  JOIN f y ON y.lang = c.lang AND y.phrase = c.phrase[c.k + 1 : len(c.phrase)] JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), free AS (
  SELECT * FROM weakest p WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = p.lang AND len(q.phrase) > len(p.phrase) AND 100 * q.f >= {covered} * p.a
    AND (q.phrase[1 : len(p.phrase)] = p.phrase OR q.phrase[2 : len(p.phrase) + 1] = p.phrase
      OR q.phrase[3 : len(p.phrase) + 2] = p.phrase OR q.phrase[4 : len(p.phrase) + 3] = p.phrase))
), ranked AS (
  SELECT *, array_to_string(phrase, ' ') AS joined FROM free
)
SELECT lang, rank, joined AS phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, joined) AS rank FROM ranked
) WHERE rank <= {most}
"""


def _op13_sql() -> str:
    fails = {
        "A": "len(w) < 200",
        "B": "100 * len(list_distinct(w)) < 50 * len(w)",
        "C": "100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text)",
        "D": "regexp_matches(text, '[#$%&*|]')",
        "E": "coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)",
    }
    bits = ", ".join(f"CAST({c} AS INT) AS {f.lower()}" for f, c in fails.items())
    letters = ", ".join(f"('{f}')" for f in FILTERS)
    hit = " + ".join(f"CASE letter WHEN '{f}' THEN {f.lower()} ELSE 0 END" for f in FILTERS)
    before = " + ".join(f"CASE WHEN strpos(filter_order, '{f}') < step THEN {f.lower()} ELSE 0 END" for f in FILTERS)
    number = " + ".join(f.lower() for f in FILTERS)
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), judged AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), marked AS (
  SELECT doc_id, part, {bits} FROM t
), known AS MATERIALIZED (
  SELECT m.*, coalesce(j.good, 0) AS good, coalesce(j.toxic, 0) AS toxic FROM marked m LEFT JOIN judged j ON j.doc_id = m.doc_id
), x(l) AS (VALUES {letters}), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS letter FROM orders, range(1, 6) s(step)
), seen AS (
  SELECT part, filter_order, step, letter, {hit} AS fails, {before} AS earlier, {number} AS failed, good, toxic FROM known, steps
), rows_of AS (
  SELECT part, filter_order, step, letter,
    count(*) FILTER (earlier = 0 AND fails = 0) AS kept, count(*) FILTER (earlier = 0 AND fails = 1) AS removed,
    count(*) FILTER (earlier > 0 AND fails = 1) AS redundant, count(*) FILTER (fails = 1 AND failed = 1) AS unique_fails,
    count(*) FILTER (earlier = 0 AND fails = 1 AND good = 1) AS good_lost, count(*) FILTER (earlier = 0 AND fails = 1 AND toxic = 1) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM rows_of
"""


ORACLES = {
    "op4_chat_format": OP4_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_sharding": _op11_sql(),
    "op12_collocations": _op12_sql(),
    "op13_filter_audit": _op13_sql(),
}
