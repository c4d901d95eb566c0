"""Registered queries for sources, ingestion transforms and corpus gates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from codicil.functions.relational import fresh_path
from codicil.operators import gates as gt
from codicil.operators import ingest as ig
from codicil.plans.inputs import LV, legal_view, table, tok
from codicil.plans.registry import register, with_
from codicil.schemas import RAW
from codicil.sources import corpus as src
from codicil.sources import tables as tb

# Raw pages ----------------------------------------------------------------

PLACE = "CASE regexp_extract(url, '/(en|de|fr|es)/', 1) WHEN 'en' THEN 'gb' WHEN 'de' THEN 'de' WHEN 'fr' THEN 'ca' ELSE 'us' END"
RAW_SQL = f"""raw AS (SELECT {PLACE} AS jurisdiction, CAST(page_id AS VARCHAR) AS source_id,
   CASE page_id % 4 WHEN 0 THEN 'case' ELSE 'statute' END AS doc_type, CAST(2020 + page_id % 5 AS INT) AS year, url, html AS body, page_id FROM pages)"""


def raw_pages(spark, sf):
    return table(spark, sf, "pages").selectExpr(
        f"{PLACE} AS jurisdiction",
        f"concat('raw-', {PLACE}) AS corpus_id",
        "CAST(page_id AS STRING) AS source_id",
        "CASE page_id % 4 WHEN 0 THEN 'case' ELSE 'statute' END AS doc_type",
        "CAST(2020 + page_id % 5 AS INT) AS year",
        "url",
        "html AS body",
        "CAST('2024-01-01' AS TIMESTAMP) AS fetched_at",
    )


@register("s01_read_raw", with_(RAW_SQL, body="""SELECT jurisdiction, year, count(*) AS sources, CAST(sum(length(body)) AS BIGINT) AS chars
  FROM raw WHERE jurisdiction IN ('gb', 'de') AND year IN (2021, 2022, 2023) GROUP BY ALL"""))
def read_raw(spark, sf):
    root = fresh_path(spark, "raw")
    src.snapshot(raw_pages(spark, sf), root, "s1")
    held = src.read_raw(spark, f"{root}/snapshot_id=s1", ["gb", "de"], [2021, 2022, 2023])
    return held.groupBy("jurisdiction", "year").agg(F.count("*").alias("sources"), F.sum(F.length("body")).alias("chars"))


@register("s02_read_corpora", """SELECT corpus_id, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS chars, count(lang) AS with_lang, count(role) AS with_role FROM (
  SELECT 'statutes' AS corpus_id, text, lang, NULL AS role FROM documents
  UNION ALL SELECT 'questions', text, NULL, NULL FROM benchmark UNION ALL SELECT 'dialogues', text, NULL, role FROM conversations) GROUP BY corpus_id""")
def read_corpora(spark, sf):
    paths = {"statutes": "documents", "questions": "benchmark", "dialogues": "conversations"}
    held = src.read_corpora(spark, {c: f"{sf}/{t}.parquet" for c, t in paths.items()})
    return held.groupBy("corpus_id").agg(
        F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("chars"), F.count("lang").alias("with_lang"), F.count("role").alias("with_role")
    )


@register("s04_snapshot", with_(RAW_SQL, body="""SELECT 's' || CAST(i AS VARCHAR) AS snapshot_id, jurisdiction, count(*) AS sources, CAST(sum(length(body)) AS BIGINT) AS chars
  FROM raw, (SELECT unnest([1, 2]) AS i) GROUP BY ALL"""))
def snapshots(spark, sf):
    root = fresh_path(spark, "snapshots")
    for name in ("s1", "s2"):
        src.snapshot(raw_pages(spark, sf), root, name)
    held = spark.read.schema(f"{RAW}, snapshot_id string").parquet(root)
    return held.groupBy("snapshot_id", "jurisdiction").agg(F.count("*").alias("sources"), F.sum(F.length("body")).alias("chars"))


# Version pair -------------------------------------------------------------

KEY = ["act", "section_no", "version"]


def version_pair(spark, sf):
    """Former and new snapshot of the legal view, with all four kinds of change."""
    lv = legal_view(spark, sf)
    amended = F.when(F.col("chunk_id") % 7 == 0, F.concat("text", F.lit(" amended"))).otherwise(F.col("text"))
    return lv.where("chunk_id % 23 <> 0"), lv.where("chunk_id % 19 <> 0").withColumn("text", amended)


PAIR = """prev AS (SELECT * FROM lv WHERE chunk_id % 23 <> 0),
fresh AS (SELECT * REPLACE (CASE WHEN chunk_id % 7 = 0 THEN text || ' amended' ELSE text END AS text) FROM lv WHERE chunk_id % 19 <> 0)"""


@register("s05_upsert", with_(LV, PAIR, body="""SELECT act, section_no, version, coalesce(f.chunk_id, p.chunk_id) AS chunk_id, md5(coalesce(f.text, p.text)) AS text_hash
  FROM prev p FULL JOIN fresh f USING (act, section_no, version)"""))
def upsert(spark, sf):
    prev, new = version_pair(spark, sf)
    once = src.upsert(prev, new, KEY)
    return src.upsert(once, new, KEY).select(*KEY, "chunk_id", F.md5("text").alias("text_hash"))


@register("s06_publish", with_(LV, PAIR,
    "want AS (SELECT jurisdiction, count(*) AS n FROM lv WHERE doc_type <> 'case' OR jurisdiction <> 'de' GROUP BY ALL)",
    "have AS (SELECT jurisdiction, count(*) AS n FROM lv GROUP BY ALL)",
    body="""SELECT jurisdiction AS corpus_id, 's1' AS snapshot_id, h.n AS chunks FROM have h JOIN want w USING (jurisdiction) WHERE h.n = w.n"""))
def publish(spark, sf):
    chunks = legal_view(spark, sf).withColumn("corpus_id", F.col("jurisdiction"))
    manifest = chunks.where("doc_type <> 'case' OR jurisdiction <> 'de'").groupBy("corpus_id").agg(F.count("*").alias("expected_count"))
    bad = gt.manifest_check(chunks, manifest).where(~F.col("matches")).select("corpus_id", F.lit("count").alias("reason"))
    root = fresh_path(spark, "publish")
    src.publish(chunks, gt.ingestion_gate(chunks, bad), root, "s1")
    live = src.read_published(spark, root)
    return live.groupBy("corpus_id", "snapshot_id").agg(F.count("*").alias("chunks"))


@register("s06_publish_again", with_(LV, """gated AS (SELECT *, jurisdiction IN ('gb', 'us') AS passes FROM lv)""",
    body="""SELECT jurisdiction AS corpus_id, CASE WHEN passes THEN 's2' ELSE 's1' END AS snapshot_id, count(*) AS chunks,
    count(*) FILTER (WHERE passes AND chunk_id % 7 = 0) AS amended FROM gated WHERE NOT passes OR chunk_id % 19 <> 0 GROUP BY ALL"""))
def publish_again(spark, sf):
    """Same id published thrice: good; other content whose gate fails; then a second snapshot that half of the corpora pass."""
    chunks = legal_view(spark, sf).withColumn("corpus_id", F.col("jurisdiction"))
    none = spark.createDataFrame([], "corpus_id string, reason string")
    root = fresh_path(spark, "publish")
    src.publish(chunks, gt.ingestion_gate(chunks, none), root, "s1")
    spoiled = chunks.withColumn("text", F.lit("spoiled amended"))
    every = chunks.select("corpus_id").distinct()
    src.publish(spoiled, gt.ingestion_gate(spoiled, every.withColumn("reason", F.lit("null"))), root, "s1")
    marked = F.when(F.col("chunk_id") % 7 == 0, F.concat("text", F.lit(" amended"))).otherwise(F.col("text"))
    new = chunks.where("chunk_id % 19 <> 0").withColumn("text", marked)
    blocked = every.where("corpus_id NOT IN ('gb', 'us')").withColumn("reason", F.lit("count"))
    src.publish(new, gt.ingestion_gate(new, blocked), root, "s2")
    live = src.read_published(spark, root)
    return live.groupBy("corpus_id", "snapshot_id").agg(
        F.count("*").alias("chunks"), F.count_if(F.col("text").endswith(" amended")).alias("amended")
    )


SYN = """syn AS (SELECT DISTINCT jurisdiction, act AS alias, act || ' act' AS canonical,
   ['law of ' || act, act || ' act', act || ' code', act || ' order', act || ' rules', act || ' statute'] AS expansions FROM lv)"""


def synonyms(spark, sf):
    """A dictionary over the held Acts: (jurisdiction, alias, canonical, expansions)."""
    return legal_view(spark, sf).select("jurisdiction", "act").distinct().selectExpr(
        "jurisdiction",
        "act AS alias",
        "act || ' act' AS canonical",
        "array('law of ' || act, act || ' act', act || ' code', act || ' order', act || ' rules', act || ' statute') AS expansions",
    )


@register("s07_load_dict", with_(LV, SYN, body="SELECT jurisdiction, CAST(2 AS INT) AS dict_version, alias, canonical, expansions FROM syn WHERE jurisdiction IN ('gb', 'ca')"))
def load_dict(spark, sf):
    path = fresh_path(spark, "dict")
    held = synonyms(spark, sf)
    for v in (1, 2):
        tb.write_dict(held.withColumn("dict_version", F.lit(v)), path)
    return tb.load_dict(spark, path, ["gb", "ca"]).select("jurisdiction", "dict_version", "alias", "canonical", "expansions")


@register("s08_read_golden", """SELECT CAST(item_id AS VARCHAR) AS qa_id, CASE item_id % 4 WHEN 0 THEN 'gb' WHEN 1 THEN 'de' WHEN 2 THEN 'ca' ELSE 'us' END AS jurisdiction,
   text AS question, 'src' || CAST(item_id % 20 AS VARCHAR) AS first_act, item_id % 4 = 3 AS must_refuse, len(CASE WHEN item_id % 5 = 0 THEN ['trap', 'compound'] ELSE ['plain'] END) AS n_tags FROM benchmark""")
def golden_json(spark, sf):
    path = fresh_path(spark, "golden")
    golden(spark, sf).write.json(path)
    return tb.read_golden(spark, path).select(
        "qa_id", "jurisdiction", "question", F.col("expected")[0]["act"].alias("first_act"), "must_refuse", F.size("tags").cast("bigint").alias("n_tags")
    )


def golden(spark, sf):
    """Golden rows over the benchmark passages."""
    return table(spark, sf, "benchmark").selectExpr(
        "CAST(item_id AS STRING) AS qa_id",
        "CASE item_id % 4 WHEN 0 THEN 'gb' WHEN 1 THEN 'de' WHEN 2 THEN 'ca' ELSE 'us' END AS jurisdiction",
        "text AS question",
        "array(named_struct('act', 'src' || CAST(item_id % 20 AS STRING), 'section_no', '1')) AS expected",
        "item_id % 4 = 3 AS must_refuse",
        "CASE WHEN item_id % 5 = 0 THEN array('trap', 'compound') ELSE array('plain') END AS tags",
    )


@register("s09_write_trace", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def traces(spark, sf):
    path = fresh_path(spark, "trace")
    tb.write_trace(table(spark, sf, "events"), path)
    held = spark.read.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, day date").parquet(path)
    return held.groupBy("day", "event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total")
    )


# Normalizing, sections, chunks ---------------------------------------------

# Character entities of the SQL side (the ampersand last).
ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&apos;", "'"),
    ("&sect;", "§"),
    ("&#167;", "§"),
    ("&para;", "¶"),
    ("&auml;", "ä"),
    ("&ouml;", "ö"),
    ("&uuml;", "ü"),
    ("&Auml;", "Ä"),
    ("&Ouml;", "Ö"),
    ("&Uuml;", "Ü"),
    ("&szlig;", "ß"),
    ("&agrave;", "à"),
    ("&ccedil;", "ç"),
    ("&eacute;", "é"),
    ("&egrave;", "è"),
    ("&ntilde;", "ñ"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&euro;", "€"),
    ("&amp;", "&"),
)


def clean_sql(html: str) -> str:
    def sub(x, pat, rep):
        return f"regexp_replace({x}, '{pat}', {rep}, 'g')"
    x = sub(html, "(?s)<!--.*?-->", "''")
    for t in ig.DROPPED:
        x = sub(x, rf"(?is)<{t}\b[^>]*>.*?</{t}>", "''")
    x = sub(sub(x, ig.BREAKS, "chr(10)"), "<[^>]+>", "''")
    for name, char in ENTITIES:
        x = "replace({}, '{}', '{}')".format(x, name.replace("'", "''"), char.replace("'", "''"))
    x = sub(x, "[ \\t]+", "' '")
    x = sub(x, r"\s*\n\s*", "chr(10)")
    return sub(x, r"^\s+|\s+$", "''")


HTML_RULES = {"de": [("ß", "ss")], "ca": [(r"\b[Aa]rticle ", "art ")]}
NORMAL = f"""norm0 AS (SELECT *, {clean_sql('html')} AS t0 FROM (SELECT *, {PLACE} AS jurisdiction FROM pages)),
norm AS (SELECT page_id, jurisdiction, html, CASE jurisdiction WHEN 'de' THEN regexp_replace(t0, 'ß', 'ss', 'g')
   WHEN 'ca' THEN regexp_replace(t0, '\\b[Aa]rticle ', 'art ', 'g') ELSE t0 END AS text FROM norm0)"""


def normal_pages(spark, sf):
    pages = table(spark, sf, "pages").withColumn("jurisdiction", F.expr(PLACE))
    return ig.normalize_html(pages, HTML_RULES)


@register("i01_normalize_html", with_(NORMAL, body="SELECT page_id, jurisdiction, text FROM norm"))
def normalized(spark, sf):
    return normal_pages(spark, sf).select("page_id", "jurisdiction", "text")


@register("i06_chunk_cases", with_(NORMAL, f"""paras AS (SELECT page_id, jurisdiction, {clean_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS headnote,
    unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS para_no FROM norm)""",
    body="SELECT * FROM paras WHERE text <> '' AND text <> headnote"))
def cases(spark, sf):
    return ig.chunk_cases(normal_pages(spark, sf))


# Statutes: the legal view with headers of every level planted by line number, in a period of twelve lines.
# {k} counts the periods; an empty mark begins no node.
MARKS = {
    "*": ["Part {k}", "Chapter {k}", "{k}. Rule", "(1)", "(a)", "(i)", "(ii)", "", "(b)", "(2)", "", ""],
    "ca": ["Part {k}", "Chapter {k}", "Article {k}", "(1)", "(a)", "(i)", "(ii)", "", "(b)", "(2)", "", ""],
    "us": ["Part {k}", "Chapter {k}", "Sec. {k}", "(a)", "(1)", "(A)", "(i)", "", "(2)", "(b)", "", ""],
    "de": ["Buch {k}", "Abschnitt {k}", "§ {k}", "(1)", "1.", "a)", "aa)", "", "2.", "(2)", "", ""],
}
# What the reference side knows of the same lines: depth, kind and number; the section has depth 3.
KNOWN = {
    "*": "0 part {k}|1 chapter {k}|3 section {k}|4 subsection 1|5 paragraph a|6 subparagraph i|6 subparagraph ii||5 paragraph b|4 subsection 2||",
    "us": "0 part {k}|1 chapter {k}|3 section {k}|4 subsection a|5 paragraph 1|6 subparagraph A|7 clause i||5 paragraph 2|4 subsection b||",
    "de": "0 book {k}|1 division {k}|3 section {k}|4 subsection 1|5 number 1|6 letter a|7 double_letter aa||5 number 2|4 subsection 2||",
}


def _planted(i: str, array: str, string: str, div: str) -> str:
    """A line with its mark, over ``l`` and its number from 0."""
    k = f"CAST({i} {div} 12 + 1 AS {string})"
    lists = {p: array.format(", ".join("'" + m.replace("{k}", f"' || {k} || '") + "'" for m in marks)) for p, marks in MARKS.items()}
    mark = "CASE jurisdiction " + " ".join(f"WHEN '{p}' THEN {v}" for p, v in lists.items() if p != "*") + f" ELSE {lists['*']} END"
    mark = f"({mark})[{i} % 12" + (" + 1]" if string == "VARCHAR" else "]")
    return f"""CASE {i} % 12 WHEN 7 THEN 'Provided that ' || l WHEN 10 THEN '"term' || CAST({i} AS {string}) || '" means ' || l
        WHEN 11 THEN 'and ' || l ELSE {mark} || ' ' || l END"""


STAT_LINE = {
    "spark": "transform(split(text, '\n'), (l, i) -> " + _planted("i", "array({})", "STRING", "DIV") + ")",
    "duck": "list_transform(string_split(text, chr(10)), lambda l, j: " + _planted("(j - 1)", "[{}]", "VARCHAR", "//") + ")",
}


def statutes(spark, sf):
    return legal_view(spark, sf).withColumn("text", F.expr(f"array_join({STAT_LINE['spark']}, '\n')"))


STAT = f"stat AS (SELECT * REPLACE (array_to_string({STAT_LINE['duck']}, chr(10)) AS text) FROM lv)"


def _known(i: str, field: int) -> str:
    """Depth, kind or number of the header on line ``i``; null where no header is planted."""
    pick = lambda v: "[" + ", ".join("'" + x.replace("{k}", f"' || CAST({i} // 12 + 1 AS VARCHAR) || '") + "'" for x in v.split("|")) + "]"
    lists = " ".join(f"WHEN '{p}' THEN {pick(v)}" for p, v in KNOWN.items() if p != "*")
    return f"nullif(string_split((CASE jurisdiction {lists} ELSE {pick(KNOWN['*'])} END)[{i} % 12 + 1], ' ')[{field}], '')"


_LIVE = {q: f"(l{q} IS NOT NULL" + "".join(f" AND l{q} > coalesce(l{p}, -1)" for p in range(q)) + ")" for q in range(8)}
_NO = {q: f"CASE WHEN {_LIVE[q]} THEN {_known(f'l{q}', 3)} END" for q in range(8)}
_TITLE = [f"CASE WHEN {_LIVE[q]} THEN upper(left({_known(f'l{q}', 2)}, 1)) || substr({_known(f'l{q}', 2)}, 2) || ' ' || {_known(f'l{q}', 3)} END" for q in range(3)]
SECTIONS = f"""ln AS (SELECT chunk_id, jurisdiction, act, unnest(string_split(text, chr(10))) AS line,
    CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS i FROM stat),
mark AS (SELECT *, CAST({_known('i', 1)} AS INT) AS depth FROM ln),
seen AS (SELECT *, count(depth) OVER w AS node, {', '.join(f'max(CASE WHEN depth = {q} THEN i END) OVER w AS l{q}' for q in range(8))}
  FROM mark WINDOW w AS (PARTITION BY chunk_id ORDER BY i)),
bodies AS (SELECT chunk_id, node, string_agg(line, chr(10) ORDER BY i) AS text, bool_or(i % 12 = 7) AS prov, bool_or(i % 12 = 10) AS def FROM seen GROUP BY ALL),
heads AS (SELECT chunk_id, i AS hi, line AS heading FROM mark WHERE depth = 3),
named AS (SELECT s.chunk_id, jurisdiction, act, list_filter([{', '.join(_TITLE)}], lambda x: x IS NOT NULL) AS division,
    {_NO[3]} AS section_no, CASE WHEN depth > 3 THEN {_known('i', 3)} END AS sub_no,
    list_filter([{', '.join(_NO[q] for q in range(3, 8))}], lambda x: x IS NOT NULL) AS section_path,
    CASE WHEN prov THEN 'proviso' WHEN def THEN 'definition' ELSE {_known('i', 2)} END AS kind, heading, b.text, i AS first_line, depth
  FROM seen s JOIN bodies b USING (chunk_id, node) LEFT JOIN heads h ON h.chunk_id = s.chunk_id AND h.hi = s.l3 AND {_LIVE[3]} WHERE depth IS NOT NULL),
sections AS (SELECT chunk_id, jurisdiction, act, division, section_no, sub_no, section_path, CASE WHEN depth > 3 THEN section_path[-2] END AS parent_no,
    CAST(len(section_path) AS INT) AS level, kind, heading, text, first_line FROM named)"""


@register("i02_detect_sections", with_(LV, STAT, SECTIONS, body="SELECT * FROM sections"))
def sections(spark, sf):
    return ig.detect_sections(statutes(spark, sf))


@register("i03_defined_terms", with_(LV, STAT, body="""SELECT DISTINCT jurisdiction, act,
   unnest(regexp_extract_all(text, '"([^"]+)" (?:means|bedeutet|includes)\\b', 1)) AS term FROM stat""".replace("\\\\b", "\\b")))
def terms(spark, sf):
    return ig.defined_terms(statutes(spark, sf))


@register("i04_chunk_sections", with_(LV, STAT, SECTIONS, body=f"""SELECT *, CAST(len({tok('text')}) AS INT) AS tokens,
   CAST(chunk_id AS VARCHAR) || ':' || CAST(first_line AS VARCHAR) AS piece_id FROM sections"""))
def chunks(spark, sf):
    return ig.chunk_sections(statutes(spark, sf))


CONTEXT = "concat_ws(' | ', act, 's ' || coalesce(array_to_string(section_path, '.'), ''), heading)"


@register("i05_parent_context", with_(LV, STAT, SECTIONS, body=f"""SELECT chunk_id, first_line, concat_ws(chr(10), {CONTEXT}, text) AS text FROM sections"""))
def contextual(spark, sf):
    return ig.with_parent_context(ig.chunk_sections(statutes(spark, sf))).select("chunk_id", "first_line", "text")


# Versions -----------------------------------------------------------------

@register("i08_version_diff", with_(LV, PAIR, r"""both_v AS (SELECT act, section_no, version, p.text AS pt, f.text AS ft, f.effective_from, f.as_at FROM prev p FULL JOIN fresh f USING (act, section_no, version)),
chg AS (SELECT *, CASE WHEN pt IS NULL THEN 'added' WHEN ft IS NULL THEN 'removed'
   WHEN trim(regexp_replace(pt, '\s+', ' ', 'g')) <> trim(regexp_replace(ft, '\s+', ' ', 'g')) THEN 'amended' ELSE 'unchanged' END AS change FROM both_v)""",
    body="""SELECT act, section_no, version, change, CASE WHEN change IN ('amended', 'removed') THEN change || ': s ' || section_no || ' of ' || act END AS amendment_note,
  CASE WHEN effective_from > DATE '2021-06-01' THEN 'commences on ' || CAST(effective_from AS VARCHAR) END AS commencement_note FROM chg"""))
def diff(spark, sf):
    prev, new = version_pair(spark, sf)
    return ig.version_diff(prev, new.withColumn("as_at", F.lit(dt.date(2021, 6, 1))), KEY)


def version_rows(spark, sf):
    """The narrow version table: keys, dates and status, no texts."""
    return legal_view(spark, sf).select("act", "section_no", "version", "status", "effective_from", "chunk_id")


IV = "iv AS (SELECT act, section_no, version, status, effective_from, chunk_id, lead(effective_from) OVER (PARTITION BY act, section_no ORDER BY version) AS effective_to FROM lv)"


@register("i09_stamp", with_(LV, IV, body="""SELECT act, section_no, version, status, effective_from, chunk_id, effective_to, DATE '2021-06-01' AS as_at,
  (effective_from <= DATE '2021-06-01' AND (effective_to IS NULL OR DATE '2021-06-01' < effective_to) AND status = 'in_force') AS in_force FROM iv"""))
def stamped(spark, sf):
    return ig.stamp(version_rows(spark, sf), dt.date(2021, 6, 1))


@register("i10_as_of", with_(LV, IV, body="""SELECT act, section_no, effective_from, version, status, chunk_id FROM iv
  WHERE effective_from <= DATE '2021-06-01' AND (effective_to IS NULL OR DATE '2021-06-01' < effective_to)"""))
def as_of(spark, sf):
    return ig.as_of(version_rows(spark, sf), dt.date(2021, 6, 1))


# Names and authority -------------------------------------------------------

def gram_sql(x: str) -> str:
    p = rf"('  ' || trim(regexp_replace(lower({x}), '\s+', ' ', 'g')) || ' ')"
    return f"list_distinct(list_transform(range(1, length({p}) - 1), lambda i: substr({p}, CAST(i AS BIGINT), 3)))"


@register("i14_trigram_match", f"""WITH names AS (SELECT DISTINCT replace(replace(p_name, 'i', 'y'), 'dg', 'g') || ' ' || lower(p_type) AS name FROM part),
  aliases AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS alias FROM part),
  sims AS (SELECT name, alias, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS s
    FROM (SELECT name, {gram_sql('name')} AS a FROM names), (SELECT alias, {gram_sql('alias')} AS b FROM aliases))
  SELECT name, alias, round(s, 6) AS similarity FROM sims WHERE s >= 0.6""")
def trigram(spark, sf):
    part = table(spark, sf, "part")
    names = part.selectExpr("replace(replace(p_name, 'i', 'y'), 'dg', 'g') || ' ' || lower(p_type) AS name")
    return ig.trigram_match(names, part.selectExpr("p_name || ' ' || lower(p_type) AS alias"), 0.6)


TREAT = """treat AS (SELECT DISTINCT source AS case_id, CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN 'apex' WHEN 1 THEN 'appeal' ELSE 'trial' END AS court,
   CAST(3 - CAST(substr(source, 4) AS INT) % 3 AS INT) AS authority_level, CASE WHEN CAST(substr(source, 4) AS INT) % 4 = 0 THEN 'overruled' ELSE 'followed' END AS treatment
   FROM documents WHERE CAST(substr(source, 4) AS INT) < 15)"""


def treatment(spark, sf):
    """Curated court table: one row per listed source."""
    n = "CAST(substr(source, 4) AS INT)"
    return table(spark, sf, "documents").where(f"{n} < 15").selectExpr(
        "source AS case_id",
        f"CASE {n} % 3 WHEN 0 THEN 'apex' WHEN 1 THEN 'appeal' ELSE 'trial' END AS court",
        f"CAST(3 - {n} % 3 AS INT) AS authority_level",
        f"CASE WHEN {n} % 4 = 0 THEN 'overruled' ELSE 'followed' END AS treatment",
    ).distinct()


@register("i15_authority", with_(TREAT, body="""SELECT doc_id AS chunk_id, source AS case_id, court, coalesce(authority_level, 0) AS authority_level, coalesce(treatment, 'unknown') AS treatment
  FROM documents LEFT JOIN treat ON source = case_id"""))
def authority(spark, sf):
    found = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("case_id"))
    return ig.with_authority(found, treatment(spark, sf)).select("chunk_id", "case_id", "court", "authority_level", "treatment")


# Gates --------------------------------------------------------------------

def corpora(spark, sf):
    return legal_view(spark, sf).withColumn("corpus_id", F.col("jurisdiction"))


def act_corpora(spark, sf):
    """Corpora as fine as an Act of a jurisdiction, so that sections do go missing."""
    return legal_view(spark, sf).withColumn("corpus_id", F.concat_ws("-", "jurisdiction", "act"))


SMOKE = "miss AS (SELECT jurisdiction || '-' || act AS corpus_id, section_no FROM lv EXCEPT SELECT jurisdiction || '-' || act, section_no FROM lv WHERE status = 'in_force')"
MANIFEST = """man AS (SELECT jurisdiction || '-' || act AS corpus_id, count(*) AS expected_count FROM prev GROUP BY ALL),
held AS (SELECT jurisdiction || '-' || act AS corpus_id, count(*) AS actual_count FROM fresh WHERE jurisdiction <> 'us' GROUP BY ALL),
checked AS (SELECT corpus_id, expected_count, actual_count, coalesce(expected_count = actual_count, false) AS matches FROM man FULL JOIN held USING (corpus_id))"""


def smoke_missing(spark, sf):
    chunks = act_corpora(spark, sf)
    smoke = chunks.select("corpus_id", "section_no").distinct()
    return gt.missing_smoke(chunks.where("status = 'in_force'"), smoke)


def manifest_checked(spark, sf):
    prev, new = version_pair(spark, sf)
    corpus = F.concat_ws("-", "jurisdiction", "act").alias("corpus_id")
    manifest = prev.groupBy(corpus).agg(F.count("*").alias("expected_count"))
    return gt.manifest_check(new.where("jurisdiction <> 'us'").withColumn("corpus_id", corpus), manifest)


@register("c01_missing_smoke", with_(LV, SMOKE, body="SELECT * FROM miss"))
def c01(spark, sf):
    return smoke_missing(spark, sf)


@register("c02_manifest_check", with_(LV, PAIR, MANIFEST, body="SELECT * FROM checked"))
def c02(spark, sf):
    return manifest_checked(spark, sf)


@register("c03_null_audit", with_(LV, """iv AS (SELECT *, lead(version) OVER (PARTITION BY act, section_no ORDER BY version) AS next_version,
    CASE WHEN status <> 'pending' THEN lead(effective_from) OVER (PARTITION BY act, section_no ORDER BY version) END AS effective_to FROM lv)""",
    body="""SELECT jurisdiction AS corpus_id, count(*) AS rows, count(*) FILTER (WHERE doc_type = 'case') AS null_as_at,
  count(*) FILTER (WHERE effective_from IS NULL) AS null_effective_from, count(*) FILTER (WHERE effective_to IS NULL AND next_version IS NOT NULL) AS null_effective_to
  FROM iv GROUP BY jurisdiction"""))
def c03(spark, sf):
    rows = corpora(spark, sf).select("corpus_id", "act", "section_no", "version", "status", "effective_from", "as_at", "doc_type")
    dated = ig.close_intervals(rows).withColumn("next_version", F.col("effective_to"))
    dated = dated.withColumn("effective_to", F.when(F.col("status") != "pending", F.col("effective_to")))
    dated = dated.withColumn("as_at", F.when(F.col("doc_type") != "case", F.col("as_at")))
    return gt.null_audit(dated, ["as_at", "effective_from", "effective_to"])


def context_faults(spark, sf):
    chunks = ig.chunk_sections(statutes(spark, sf))
    whole = ig.with_parent_context(chunks)
    return gt.context_check(whole.withColumn("text", F.when(F.col("kind") == "proviso", F.substring("text", 2, 1 << 30)).otherwise(F.col("text"))))


@register("c04_context_check", with_(LV, STAT, SECTIONS, body="SELECT chunk_id, first_line, kind FROM sections WHERE kind = 'proviso'"))
def c04(spark, sf):
    return context_faults(spark, sf).select("chunk_id", "first_line", "kind")


@register("c05_ingestion_gate", with_(LV, PAIR, SMOKE, MANIFEST, """reasons AS (SELECT corpus_id, 'smoke' AS reason FROM miss
   UNION SELECT corpus_id, 'count' FROM checked WHERE NOT matches)""",
   body="""SELECT c.corpus_id, count(reason) = 0 AS passed, coalesce(list(DISTINCT reason ORDER BY reason) FILTER (WHERE reason IS NOT NULL), []) AS reasons
  FROM (SELECT DISTINCT jurisdiction || '-' || act AS corpus_id FROM lv) c LEFT JOIN reasons USING (corpus_id) GROUP BY c.corpus_id"""))
def c05(spark, sf):
    smoke = smoke_missing(spark, sf).select("corpus_id", F.lit("smoke").alias("reason"))
    counts = manifest_checked(spark, sf).where("NOT matches").select("corpus_id", F.lit("count").alias("reason"))
    return gt.ingestion_gate(act_corpora(spark, sf), smoke, counts)


@register("c06_coverage_gaps", with_(LV, """acts AS (SELECT DISTINCT act FROM lv), places AS (SELECT unnest(['za', 'gb', 'us', 'ca', 'au', 'ie', 'de', 'nz']) AS corpus_id)""",
    body="""SELECT corpus_id, act FROM acts, places EXCEPT SELECT jurisdiction, act FROM lv WHERE doc_type = 'regulation' AND status = 'in_force'"""))
def c06(spark, sf):
    from codicil.schemas import COUNTRIES

    chunks = corpora(spark, sf)
    wanted = chunks.select("act").distinct().withColumn("corpus_id", F.explode(F.array(*map(F.lit, COUNTRIES))))
    return gt.coverage_gaps(wanted, chunks.where("doc_type = 'regulation' AND status = 'in_force'"), ["corpus_id", "act"]).select("corpus_id", "act")


LANE = "CAST(sum(CAST(('0x' || substr(h, {}, 15)) AS BIGINT)) AS VARCHAR)"


@register("c07_sign_manifest", with_(LV, "hs AS (SELECT jurisdiction AS corpus_id, sha256(" + " || ',' || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in ("CAST(chunk_id AS VARCHAR)", "act", "section_no", "CAST(version AS VARCHAR)", "text")) + ") AS h FROM lv)",
   f"sums AS (SELECT corpus_id, count(*) AS rows, sha256(concat_ws(':', corpus_id, CAST(count(*) AS VARCHAR), {', '.join(LANE.format(1 + 15 * i) for i in range(4))})) AS digest FROM hs GROUP BY corpus_id)",
   body="SELECT corpus_id, rows, digest, corpus_id || '-' || substr(digest, 1, 16) AS corpus_snapshot_id FROM sums"))
def c07(spark, sf):
    return gt.sign_manifest(corpora(spark, sf), b"manifest-key", ["chunk_id", "act", "section_no", "version", "text"]).drop("signature")


PINS = """pins AS (SELECT DISTINCT jurisdiction, CASE jurisdiction WHEN 'gb' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS snapshot_id FROM lv)"""


@register("c08_read_pinned", with_(LV, PINS, body="SELECT jurisdiction, version AS snapshot_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM lv JOIN pins p ON p.jurisdiction = lv.jurisdiction AND p.snapshot_id = lv.version GROUP BY ALL".replace("SELECT jurisdiction,", "SELECT lv.jurisdiction,")))
def c08(spark, sf):
    held = legal_view(spark, sf).withColumn("snapshot_id", F.col("version"))
    pins = held.select("jurisdiction").distinct().withColumn(
        "snapshot_id", F.when(F.col("jurisdiction") == "gb", 1).when(F.col("jurisdiction") == "de", 2).otherwise(3)
    )
    return gt.read_pinned(held, pins).groupBy("jurisdiction", "snapshot_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


@register("c09_ingest_timings", "SELECT event_type AS corpus_id, count(*) AS steps, min(ts) AS started, max(ts) AS ended, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM events GROUP BY event_type")
def c09(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_type").alias("corpus_id"), F.col("ts").cast("timestamp").alias("ts"))
    return gt.ingest_timings(log).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})
