"""Hand-worked cases on the forms that synthetic tables do not hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codicil.functions import relational
from codicil.operators import ingest as ig
from codicil.operators import retrieval as rt
from codicil.operators import understanding as un
from codicil.operators import verification as vf
from codicil.sources import corpus as src
from codicil.streaming import monitors as mo


def test_upsert_with_null_and_repeated_keys(spark):
    old = spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string")
    new = spark.createDataFrame([(None, "c")], "k int, v string")
    twice = src.upsert(src.upsert(old, new, ["k"]), new, ["k"])
    assert sorted(map(tuple, twice.collect()), key=repr) == [(1, "b"), (None, "c")]
    with pytest.raises(ValueError):
        src.upsert(old, new.union(new), ["k"])


def test_the_last_published_snapshot_counts(spark, tmp_path):
    root = str(tmp_path / "published")
    rows = spark.createDataFrame([("za", 1)], "corpus_id string, v int")
    gate = spark.createDataFrame([("za", True, [])], "corpus_id string, passed boolean, reasons array<string>")
    for v, name in [(1, "s9"), (2, "s10")]:
        src.publish(rows.withColumn("v", F.lit(v)), gate, root, name)
    assert [(r.v, r.snapshot_id) for r in src.read_published(spark, root).collect()] == [(2, "s10")]


def test_diff_of_null_sections_and_texts(spark):
    rows = spark.createDataFrame(
        [("a", None, "t", dt.date(2020, 1, 1)), ("a", "2", None, dt.date(2020, 1, 1))],
        "act string, section_no string, text string, effective_from date",
    ).withColumn("as_at", F.col("effective_from"))
    assert [r.change for r in ig.version_diff(rows, rows, ["act", "section_no"]).collect()] == ["unchanged"] * 2


def test_as_of_respects_a_given_end(spark):
    rows = spark.createDataFrame(
        [("a", "1", 1, dt.date(2020, 1, 1), dt.date(2021, 1, 1))],
        "act string, section_no string, version int, effective_from date, effective_to date",
    )
    assert ig.as_of(rows, dt.date(2020, 6, 1)).count() == 1 and ig.as_of(rows, dt.date(2022, 1, 1)).count() == 0


def test_acts_of_any_length_and_by_number(spark):
    acts = spark.createDataFrame(
        [("Basic Conditions of Employment Act", "bcea"), ("BCEA", "bcea"), ("Act 71 of 2008", "companies"), ("Companies Act", "companies")],
        "alias string, act string",
    )
    asked = spark.createDataFrame(
        [(1, "Does the Basic Conditions of Employment Act apply?"), (2, "Companies Act 71 of 2008"), (3, "see Act No. 66 of 1995 or BCEA")],
        "query_id int, text string",
    )
    got = sorted(map(tuple, un.named_acts(asked, acts).collect()))
    assert got == [(1, "bcea"), (2, "companies"), (3, "Act 66 of 1995"), (3, "bcea")]


def test_fusion_and_boosts_keep_what_is_asked(spark):
    ranked = spark.range(100).select(F.lit(1).alias("query_id"), F.col("id").alias("chunk_id"), (F.col("id") + 1).alias("rank"))
    fused = rt.rrf([ranked, ranked], pool=100)
    assert fused.count() == 100
    assert rt.boost(fused, {"even": (F.col("chunk_id") % 2 == 0, 0.5)}, pool=100).count() == 100


def test_a_second_call_takes_only_new_files(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (3, 5):
        spark.range(n).coalesce(1).write.mode("append").parquet(source)
        got = mo.run_available(mo.stream_table(spark, source, "id bigint"), "again", path=sink)
    assert got.count() == 8


def test_broadcasts_are_bounded_in_bytes(spark, monkeypatch):
    df = spark.range(10).withColumn("wide", F.repeat(F.lit("x"), 1000))
    assert relational.small_side(df) is not df
    monkeypatch.setattr(relational, "BROADCAST_BYTES", 5000)
    assert relational.small_side(df) is df


def test_references_as_they_are_written(spark):
    forms = [
        ("under sections 9145 and 9146", ["9145", "9146"]),
        ("s. 9145 and Sec. 12(1)", ["9145", "12(1)"]),
        ("arts 5, 6 or 7 and reg 9145", ["5", "6", "7", "9145"]),
        ("§§ 5, 9146", ["5", "9146"]),
        ("ss 5 to 9", ["5", "9"]),
        ("s 5 and 10 days", ["5"]),
        ("s 9 and s 37", ["9", "37"]),
        ("classes 5 and items 6", []),
    ]
    df = spark.createDataFrame(forms, "text string, want array<string>").select("text", "want", vf.refs_of(F.col("text")).alias("got"))
    assert {r.text: set(r.got) for r in df.collect()} == {t: set(w) for t, w in forms}


def test_abbreviations_do_not_end_a_claim(spark):
    text = "Under s. 9145 of Act No. 66 the employer must pay [1]. No. It ends in s.\nNew line."
    got = vf.split_claims(spark.createDataFrame([(1, 1, text)], "query_id bigint, attempt int, text string")).orderBy("claim_no").collect()
    assert [r.claim for r in got] == ["Under s. 9145 of Act No. 66 the employer must pay [1].", "No.", "It ends in s.", "New line."]
    assert got[0].cited == [1]


def test_named_entities(spark):
    df = spark.createDataFrame([("<p>&sect; 5 Bu&szlig;geld &#167; 6 &amp;lt;</p>",)], "html string")
    assert ig.normalize_html(df).first().text == "§ 5 Bußgeld § 6 &lt;"
