import datetime as dt
import hashlib
import hmac
import itertools

import pytest
from pyspark.sql import functions as F

from codicil.functions.relational import fresh_path
from codicil.operators import gates as gt
from codicil.operators import ingest as ig
from codicil.sources import corpus as src
from codicil.sources import tables as tb

LAW = """Short title
Section 1 Definitions
"worker" means a person who works.
(1) First part
(2) Second part
Provided that it applies.
Section 145 Review
Any party may apply."""


@pytest.fixture(scope="module")
def law(spark):
    de = "§ 1 Anfang\nText eins\n§ 2 Ende\nText zwei"
    return spark.createDataFrame(
        [(1, "za", "lra", LAW), (2, "de", "bgb", de), (3, "za", "lra", "no header at all")],
        "chunk_id bigint, jurisdiction string, act string, text string",
    )


def test_section_tree(law):
    got = [(r.section_no, r.sub_no, r.parent_no, r.level, r.kind, r.heading) for r in ig.detect_sections(law).where("chunk_id = 1").orderBy("first_line").collect()]
    assert got == [
        (None, None, None, 0, "preamble", None),
        ("1", None, None, 1, "definition", "Section 1 Definitions"),
        ("1", "1", "1", 2, "subsection", "Section 1 Definitions"),
        ("1", "2", "1", 2, "proviso", "Section 1 Definitions"),
        ("145", None, None, 1, "section", "Section 145 Review"),
    ]


def test_sections_follow_the_jurisdiction_and_lose_no_line(law):
    parts = ig.detect_sections(law)
    assert [r.section_no for r in parts.where("chunk_id = 2").orderBy("first_line").collect()] == ["1", "2"]
    assert parts.where("chunk_id = 3").count() == 1
    for doc in law.collect():
        mine = parts.where(F.col("chunk_id") == doc.chunk_id).orderBy("first_line").collect()
        assert "\n".join(r.text for r in mine) == doc.text


def test_sections_need_no_shuffle(law):
    assert "Exchange" not in ig.chunk_sections(law)._jdf.queryExecution().executedPlan().toString()


def test_terms_and_context(law):
    assert [r.term for r in ig.defined_terms(law).collect()] == ["worker"]
    whole = ig.with_parent_context(ig.chunk_sections(law))
    assert gt.context_check(whole).count() == 0
    first = whole.where("sub_no = '2'").first().text
    assert first.startswith("lra | s 1.2 | Section 1 Definitions\n(2) Second part")
    assert gt.context_check(whole.withColumn("text", F.lit("x"))).count() == whole.count()


def test_html(spark):
    page = "<html><head><title>t</title></head><body><script>var x='</p>';</script><h1>A &amp; B</h1><p>One<br>two</p><!-- no --><footer>f</footer></body></html>"
    df = spark.createDataFrame([("de", page)], "jurisdiction string, html string")
    assert ig.normalize_html(df).first().text == "A & B\nOne\ntwo"
    assert ig.normalize_html(df, {"de": [("One", "Eins")], "gb": [("two", "2")]}).first().text == "A & B\nEins\ntwo"


@pytest.fixture(scope="module")
def versions(spark):
    d = dt.date
    return spark.createDataFrame(
        [("a", "1", 1, "in_force", d(2020, 1, 1), "old"), ("a", "1", 2, "in_force", d(2022, 1, 1), "new"), ("a", "2", 1, "repealed", d(2021, 1, 1), "x")],
        "act string, section_no string, version int, status string, effective_from date, text string",
    )


def test_intervals_are_half_open(versions):
    def at(d):
        return {(r.section_no, r.version) for r in ig.as_of(versions, d).collect()}

    assert at(dt.date(2021, 12, 31)) == {("1", 1), ("2", 1)}
    assert at(dt.date(2022, 1, 1)) == {("1", 2), ("2", 1)}
    assert at(dt.date(2019, 1, 1)) == set()
    flags = {(r.section_no, r.version): r.in_force for r in ig.stamp(versions, dt.date(2022, 1, 1)).collect()}
    assert flags == {("1", 1): False, ("1", 2): True, ("2", 1): False}


def test_diff(spark, versions):
    v = versions.withColumn("as_at", F.lit(dt.date(2021, 6, 1)))
    assert {r.change for r in ig.version_diff(v, v, ["act", "section_no", "version"]).collect()} == {"unchanged"}
    spaced = v.withColumn("text", F.concat(F.lit(" "), "text", F.lit("\n")))
    assert {r.change for r in ig.version_diff(v, spaced, ["act", "section_no", "version"]).collect()} == {"unchanged"}
    got = {
        (r.section_no, r.version): (r.change, r.amendment_note, r.commencement_note)
        for r in ig.version_diff(
            v.where("version = 1"), v.where("section_no = '1'").withColumn("text", F.lit("z")), ["act", "section_no", "version"]
        ).collect()
    }
    assert got[("1", 1)] == ("amended", "amended: s 1 of a", None)
    assert got[("1", 2)] == ("added", None, "commences on 2022-01-01")
    assert got[("2", 1)] == ("removed", "removed: s 2 of a", None)


def grams(name):
    p = f"  {name.lower()} "
    return {p[i : i + 3] for i in range(len(p) - 2)}


def test_trigrams_against_brute_force(spark):
    words = ["labour relations act", "labor relation act", "basic conditions", "basic condition of employment", "tax act", "ta", "a"]
    names = spark.createDataFrame([(w,) for w in words] * 3, "name string")
    aliases = names.select(F.col("name").alias("alias"))
    for t in (0.3, 0.5, 0.9):
        want = {(a, b) for a, b in itertools.product(words, words) if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= t}
        assert {(r.name, r.alias) for r in ig.trigram_match(names, aliases, t).collect()} == want


def test_smoke_and_manifest_gate(spark):
    chunks = spark.createDataFrame([("za", "1"), ("za", "2"), ("gb", "1"), ("us", "1")], "corpus_id string, section_no string")
    smoke = spark.createDataFrame([("za", "1"), ("gb", "1"), ("gb", "9")], "corpus_id string, section_no string")
    manifest = spark.createDataFrame([("za", 2), ("gb", 1)], "corpus_id string, expected_count bigint")
    missing = gt.missing_smoke(chunks, smoke)
    assert [tuple(r) for r in missing.collect()] == [("gb", "9")]
    bad = gt.manifest_check(chunks, manifest).where("NOT matches")
    gate = {
        r.corpus_id: (r.passed, r.reasons)
        for r in gt.ingestion_gate(
            chunks, missing.withColumn("reason", F.lit("smoke")), bad.withColumn("reason", F.lit("count"))
        ).collect()
    }
    assert gate == {"za": (True, []), "gb": (False, ["smoke"]), "us": (False, ["count"])}


def test_signature(spark):
    chunks = spark.createDataFrame([("za", 1, "a"), ("za", 2, "b"), ("gb", 3, "a")], "corpus_id string, chunk_id int, text string")
    got = {r.corpus_id: r for r in gt.sign_manifest(chunks, b"key", ["chunk_id", "text"]).collect()}
    again = {r.corpus_id: r for r in gt.sign_manifest(chunks.repartition(5), b"key", ["chunk_id", "text"]).collect()}
    assert got == again
    z = got["za"]
    assert z.signature == hmac.new(b"key", z.digest.encode(), hashlib.sha256).hexdigest()
    assert z.corpus_snapshot_id == f"za-{z.digest[:16]}"
    changed = gt.sign_manifest(chunks.withColumn("text", F.lit("a")), b"key", ["chunk_id", "text"])
    assert {r.corpus_id: r.digest for r in changed.collect()}["za"] != z.digest
    copied = gt.sign_manifest(chunks.unionAll(chunks.where("chunk_id = 1")), b"key", ["chunk_id", "text"])
    assert {r.corpus_id: r.digest for r in copied.collect()}["za"] != z.digest


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = src.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, src.upsert(once, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]


def test_publish_keeps_the_former_snapshot_of_a_blocked_corpus(spark):
    root = fresh_path(spark, "pub")
    first = spark.createDataFrame([("za", 1), ("gb", 2)], "corpus_id string, v int")
    ok = spark.createDataFrame([("za", True, []), ("gb", True, [])], "corpus_id string, passed boolean, reasons array<string>")
    src.publish(first, ok, root, "s1")
    blocked = spark.createDataFrame([("za", True, []), ("gb", False, ["smoke"])], ok.schema)
    src.publish(first.withColumn("v", F.col("v") * 10), blocked, root, "s2")
    assert {(r.corpus_id, r.v, r.snapshot_id) for r in src.read_published(spark, root).collect()} == {("za", 10, "s2"), ("gb", 2, "s1")}


def test_snapshots_are_immutable(spark):
    root = fresh_path(spark, "snap")
    df = spark.createDataFrame([("za", 1)], "jurisdiction string, v int")
    src.snapshot(df, root, "s1")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        src.snapshot(df, root, "s1")


def test_raw_text_files(spark, tmp_path):
    for place in ("za", "gb"):
        (tmp_path / f"jurisdiction={place}").mkdir()
        (tmp_path / f"jurisdiction={place}" / "a.html").write_text(f"<p>{place}</p>\nmore")
    got = {r.jurisdiction: r.body for r in src.read_raw_text(spark, str(tmp_path)).collect()}
    assert got == {"za": "<p>za</p>\nmore", "gb": "<p>gb</p>\nmore"}


def test_dictionary_versions(spark):
    path = fresh_path(spark, "dict")
    base = spark.createDataFrame([("za", "BCEA", "basic conditions", ["x"])], "jurisdiction string, alias string, canonical string, expansions array<string>")
    for v in (1, 2):
        tb.write_dict(base.withColumn("dict_version", F.lit(v)), path)
    tb.write_dict(base.withColumn("jurisdiction", F.lit("gb")).withColumn("dict_version", F.lit(1)), path)
    assert {(r.jurisdiction, r.dict_version) for r in tb.load_dict(spark, path).collect()} == {("za", 2), ("gb", 1)}
    assert tb.load_dict(spark, path, ["za"], 1).count() == 1


def test_traces_hold_no_bodies(spark):
    path = fresh_path(spark, "trace")
    tb.write_trace(spark.createDataFrame([("r1", dt.datetime(2024, 1, 1), "secret", "p")], "request_id string, ts timestamp, text string, prompt string"), path)
    assert set(spark.read.parquet(path).columns) == {"request_id", "ts", "day"}


def test_pins(spark):
    chunks = spark.createDataFrame([("za", "s1", 1), ("za", "s2", 2), ("gb", "s1", 3)], "jurisdiction string, snapshot_id string, v int")
    pins = spark.createDataFrame([("za", "s2")], "jurisdiction string, snapshot_id string")
    assert [r.v for r in gt.read_pinned(chunks, pins).collect()] == [2]


def test_entities_decode_as_the_standard_library_does(spark):
    import html

    texts = [
        "&#8211; &#xA7; &#XA7; &hellip; &iacute; &amp;lt; &amp;amp; a&b; &unknown; &#128512; &#150; &#x93;q&#x94;",
        "&& &; &#; &#x; &lt;p&gt; &#39;x&#39; &apos; AT&T; &eacute;&Eacute;", "no reference", "", "&#0; &#xD800; &#1114112; &#999999999;",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {r.i: r.x for r in df.select("i", ig.decode_entities(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [html.unescape(t) for t in texts] and got[len(texts)] is None
    blank = df.limit(1).select(ig.decode_entities(F.lit("a&nbsp;b&#160;c&#xa0;d")).alias("x")).first().x
    assert blank == "a b c d"
