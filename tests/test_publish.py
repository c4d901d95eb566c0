"""Publishing: atomic, addressed by content, and signed without ambiguity."""

import pytest

from codicil.operators import gates as gt
from codicil.sources import corpus as src

GATE = "corpus_id string, passed boolean, reasons array<string>"


def rows(spark, *values):
    return spark.createDataFrame(values, "corpus_id string, text string")


def gate(spark, **passed):
    return spark.createDataFrame([(c, p, [] if p else ["bad"]) for c, p in passed.items()], GATE)


def seen(spark, root):
    return sorted((r.corpus_id, r.text, r.snapshot_id) for r in src.read_published(spark, root).collect())


def test_a_failed_gate_shows_nothing_even_under_a_published_id(spark, tmp_path):
    root = str(tmp_path / "r")
    src.publish(rows(spark, ("za", "good")), gate(spark, za=True), root, "s1")
    decided = src.publish(rows(spark, ("za", "BAD")), gate(spark, za=False), root, "s1")
    assert [(r.corpus_id, r.passed, r.snapshot_id) for r in decided.collect()] == [("za", False, "s1")]
    assert seen(spark, root) == [("za", "good", "s1")]
    src.publish(rows(spark, ("za", "better")), gate(spark, za=True), root, "s1")
    assert seen(spark, root) == [("za", "better", "s1")]
    src.publish(rows(spark, ("za", "good")), gate(spark, za=True), root, "s0")
    assert seen(spark, root) == [("za", "good", "s0")]


def test_equal_content_is_staged_once(spark, tmp_path):
    root = tmp_path / "r"
    one = rows(spark, ("za", "a"), ("za", None), ("007", "b"), ("007", "b"))
    for name in ("s1", "s2"):
        src.publish(one.repartition(3), gate(spark, za=True, **{"007": True}), str(root), name)
    assert len(list((root / "staging").iterdir())) == 1
    assert len(src.read_published(spark, str(root)).collect()) == 4
    assert {r.snapshot_id for r in src.read_published(spark, str(root)).collect()} == {"s2"}
    address = src.content_address(one)
    assert address == src.content_address(one.repartition(2).select("text", "corpus_id"))
    assert address != src.content_address(one.fillna("")) != src.content_address(one.distinct())


def test_a_run_that_ends_before_its_log_entry_shows_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "r")
    with pytest.raises(ValueError):
        src.read_published(spark, root)
    src.publish(rows(spark, ("za", "a")), gate(spark, za=True), root, "s1")

    def lost(self):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(src._Log, "append", lost)
        with pytest.raises(RuntimeError):
            src.publish(rows(spark, ("za", "b")), gate(spark, za=True), root, "s2")
    assert seen(spark, root) == [("za", "a", "s1")]
    src.publish(rows(spark, ("za", "b")), gate(spark, za=True), root, "s2")
    assert seen(spark, root) == [("za", "b", "s2")]


def test_numbers_are_claimed_once(spark, tmp_path):
    one, two = (src._Log(spark, str(tmp_path / "n")) for _ in range(2))
    assert [one.append(), two.append(), one.append(), two.append()] == [1, 2, 3, 4] and one.entries() == [1, 2, 3, 4]


def test_only_blocked_corpora_give_an_empty_table(spark, tmp_path):
    root = str(tmp_path / "r")
    src.publish(rows(spark, ("za", "a")), gate(spark, za=False), root, "s1")
    assert src.read_published(spark, root).columns and seen(spark, root) == []


def test_signatures_tell_nulls_and_separators_apart(spark):
    cases = [("q", None), ("q", ""), ("q\x1fr", ""), ("q", "r\x1f"), ("q,1", "r"), ("q", "1,r"), ("1:q", ""), (None, "q"), ("-", None)]
    digests = set()
    for act, text in cases:
        chunks = spark.createDataFrame([("za", act, text)], "corpus_id string, act string, text string")
        digests.add(gt.sign_manifest(chunks, b"k", ["act", "text"]).first().digest)
    assert len(digests) == len(cases)


def test_traces_hold_allowed_fields_only(spark, tmp_path):
    import datetime as dt

    from codicil.sources import tables as tb

    row = ("r1", dt.datetime(2024, 1, 1), "za", 0.5, "a body", "an answer", "a claim", "a prompt")
    shape = "request_id string, ts timestamp, jurisdiction string, score double, context string, answer string, claim string, anything string"
    tb.write_trace(spark.createDataFrame([row], shape), str(tmp_path / "trace"))
    assert set(spark.read.parquet(str(tmp_path / "trace")).columns) == {"request_id", "ts", "jurisdiction", "score", "day"}
