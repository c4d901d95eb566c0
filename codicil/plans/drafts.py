"""Drafted answers and their excerpts, one set per document, with planted faults.

Each line of a document is an excerpt; the draft restates every line with a
section reference and a citation. Faults follow from the document and line
numbers: attempt 1 has them all, attempt 2 only for every third document. All of
it is built inside the document's row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.plans.inputs import table

SECTION = "CAST(i * 3 + doc_id % 4 AS {s})"
FAULT = "(attempt = 1 OR doc_id % 3 = 0)"


def _sentence(s: str, clean: str, i: str) -> str:
    sec = SECTION.format(s=s).replace("i * 3", f"{i} * 3")
    claim = (
        f"CASE WHEN {FAULT} AND (doc_id + {i}) % 23 = 0 THEN 'zzq ' || md5(l) "
        f"WHEN {FAULT} AND (doc_id + {i}) % 29 = 0 THEN 'not ' || {clean} ELSE {clean} END"
    )
    lead = f"CASE WHEN (doc_id + {i}) % 13 = 0 THEN 'The controlling provision is ' ELSE '' END"
    ref = f"CASE WHEN {FAULT} AND (doc_id + 2 * {i}) % 19 = 0 THEN '9145' WHEN {i} % 4 = 0 THEN {sec} || '(1)' ELSE {sec} END"
    cite = (
        f"CASE WHEN doc_id % 31 = 0 THEN '' WHEN {FAULT} AND (doc_id + {i}) % 17 = 0 THEN ' [' || CAST({i} + 1000 AS {s}) || ']' "
        f"WHEN (doc_id + {i}) % 5 = 0 THEN ' [' || CAST({i} AS {s}) || '][1]' ELSE ' [' || CAST({i} AS {s}) || ']' END"
    )
    return f"({lead}) || ({claim}) || ' under s ' || ({ref}) || ({cite}) || '.'"


CLEAN_SPARK = r"regexp_replace(l, '[^\\p{L}\\p{N} ]+', ' ')"
CLEAN_DUCK = r"regexp_replace(l, '[^\p{L}\p{N} ]+', ' ', 'g')"

EXCERPT = {
    "act": "CASE WHEN (doc_id + i) % 6 = 0 THEN 'src' || CAST((doc_id + i) % 20 AS {s}) ELSE source END",
    "section_no": SECTION,
    "text": "l || ' See s ' || " + SECTION + " || CASE WHEN i % 4 = 0 THEN ' (1)' ELSE '' END",
    "status": "CASE WHEN (doc_id + i) % 11 = 0 THEN 'repealed' WHEN (doc_id + i) % 13 = 0 THEN 'pending' ELSE 'in_force' END",
}


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode_outer(F.split("text", "\n")).alias("p", "l"))
    rows = rows.withColumn("i", F.col("p") + 1)
    return rows.selectExpr(
        "doc_id AS query_id",
        "CAST(i AS BIGINT) AS n",
        *[f"{e.format(s='STRING')} AS {c}" for c, e in EXCERPT.items()],
        "date_add(DATE '2024-01-01', CAST((doc_id + i) % 30 AS INT)) AS as_at",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = f"transform(split(text, '\n'), l -> named_struct('l', l, 'clean', {CLEAN_SPARK})) AS lines"
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", lines).selectExpr("*", "explode(array(1, 2)) AS attempt")
    body = _sentence("STRING", "p.clean", "(j + 1)").replace("md5(l)", "md5(p.l)")
    tail = "CASE WHEN doc_id % 2 = 0 THEN '\nSome provisions are repealed or pending.' ELSE '' END"
    return rows.selectExpr(
        "doc_id AS query_id", "attempt", f"array_join(transform(lines, (p, j) -> {body}), '\n') || {tail} AS text"
    )


DRAFTS = f"""dl AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
exc AS (SELECT doc_id AS query_id, CAST(i AS BIGINT) AS n, {', '.join(e.format(s='VARCHAR') + ' AS ' + c for c, e in EXCERPT.items())},
   CAST(DATE '2024-01-01' + CAST((doc_id + i) % 30 AS INT) AS DATE) AS as_at FROM dl),
ans AS (SELECT doc_id AS query_id, attempt, string_agg({_sentence('VARCHAR', CLEAN_DUCK, 'i')}, chr(10) ORDER BY i)
     || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Some provisions are repealed or pending.' ELSE '' END AS text
   FROM dl, (SELECT unnest([1, 2]) AS attempt) GROUP BY doc_id, attempt)"""
