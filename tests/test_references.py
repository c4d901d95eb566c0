"""Ranges of sections, parts of sections, and sentence ends inside case names."""

import random

from pyspark.sql import functions as F

from codicil.operators import verification as vf


def test_ranges_and_parts_as_they_are_written(spark):
    forms = [
        ("ss 5 to 9", [(5, 9)], []),
        ("sections 3, 5–9 and 12 to 14", [(5, 9), (12, 14)], []),
        ("§§ 5 bis 9 und 11", [(5, 9)], []),
        ("ss 9 to 5", [], []),
        ("s 5 to 9 days", [], []),
        ("paragraph 9 and subsection (3)", [], ["(9)", "(3)"]),
        ("subsection (3) of section 5", [], ["5(3)"]),
        ("Absatz 2 des Art 6, para (a)", [], ["6(2)", "(a)"]),
        ("dinero para el pago, sub judice", [], []),
    ]
    df = spark.createDataFrame([f[0] for f in forms], "string").select(
        "value", vf.ranges_of(F.col("value")).alias("r"), vf.inner_refs_of(F.col("value")).alias("i")
    )
    assert {r.value: ([tuple(x) for x in r.r], sorted(r.i)) for r in df.collect()} == {t: (a, sorted(b)) for t, a, b in forms}


def test_dotted_numbers(spark):
    df = spark.createDataFrame(["Section 1.2 and s 3. Next"], "string").select(vf.refs_of(F.col("value")).alias("r"))
    assert df.first().r == ["1.2", "3"]


def test_order_of_section_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("13", "12A", "12", "112", "9", "12b")], "no string")
    assert [r.no for r in df.orderBy(vf.section_order(F.col("no"))).collect()] == ["9", "12", "12A", "12b", "13", "112"]


def test_gaps(spark):
    rows = [(5, 9, [6, 7, 8]), (5, 9, []), (5, 9, [7, 7, 5, 9, 100]), (5, 6, []), (1, 10**15, [2, 500])]
    df = spark.createDataFrame(rows, "low bigint, high bigint, held array<bigint>")
    got = [r.g for r in df.select(vf.gaps_between(F.col("low"), F.col("high"), F.col("held")).alias("g")).collect()]
    assert got == [[], ["6 to 8"], ["6", "8"], [], ["3 to 499", f"501 to {10**15 - 1}"]]


def test_section_realism_reports_gaps_and_parts(spark):
    claims = vf.split_claims(spark.createDataFrame(
        [(1, 1, "Rules of ss 5 to 9 hold, see subsection (3) and paragraph 4 [1][2]."), (2, 1, "ss 5 to 6 apply [1]."), (3, 1, "ss 5 to 9 [7].")],
        "query_id bigint, attempt int, text string",
    ))
    excerpts = spark.createDataFrame(
        [(1, 1, "5", "(3) any party, as in 7"), (1, 2, "9", "nothing"), (2, 1, "5", "and 6")], "query_id bigint, n bigint, section_no string, text string"
    )
    got = {(r.query_id, r.ref) for r in vf.section_realism(claims, excerpts).collect()}
    assert got == {(1, "6"), (1, "8"), (1, "(4)"), (3, "5"), (3, "9"), (3, "6 to 8")}


def test_review_of_ranges_equals_a_plain_loop(spark):
    draw = random.Random(8)
    held = [(f"act{a}", f"{n}{s}", "in_force" if draw.random() < 0.7 else "repealed") for a in range(3) for n in range(1, 60) if draw.random() < 0.6 for s in draw.choice([("",), ("", "A"), ("B",)])]
    drafts = [(k, f"act{draw.randint(0, 3)}", lo := draw.randint(1, 50), lo + draw.choice([1, 2, 7, 40, 10**6])) for k in range(60)]
    live = {(a, n): st == "in_force" for a, n, st in held}
    want = set()
    for k, act, lo, hi in drafts:
        for end in (lo, hi):
            if not live.get((act, str(end)), False):
                want.add((k, act, str(end), "not_held" if (act, str(end)) not in live else "not_in_force"))
        inside = sorted((int(n.rstrip("AB")), n) for a, n in live if a == act and lo < int(n.rstrip("AB")) < hi)
        want |= {(k, act, n, "not_in_force") for _, n in inside if not live[act, n]}
        stops = [lo, *sorted({i for i, _ in inside}), hi]
        for a, b in zip(stops, stops[1:]):
            if b - a > 1:
                want.add((k, act, str(a + 1) if b - a == 2 else f"{a + 1} to {b - 1}", "not_held"))
    texts = spark.createDataFrame([(k, act, f"Under ss {lo} to {hi}.") for k, act, lo, hi in drafts], "doc_id bigint, act string, text string")
    got = vf.review_documents(texts, spark.createDataFrame(held, "act string, section_no string, status string"))
    assert {tuple(r) for r in got.collect()} == want


def test_case_names_and_initials_do_not_end_a_claim(spark):
    text = "Acme v. Smith holds [2]. This is so, i.e. always. J. Doe agrees, e.g. here, etc. and more. Plans end etc. The rest."
    got = vf.split_claims(spark.createDataFrame([(1, 1, text)], "query_id bigint, attempt int, text string")).orderBy("claim_no").collect()
    assert [r.claim for r in got] == [
        "Acme v. Smith holds [2].", "This is so, i.e. always.", "J. Doe agrees, e.g. here, etc. and more.", "Plans end etc.", "The rest."
    ]
    assert got[0].cited == [2]


def test_phrase_synonyms(spark):
    from codicil.operators import understanding as un

    asked = [(1, "za", "BCEA notice period"), (2, "za", "The Basic Conditions of Employment Act, and BCEA again"), (3, "gb", "BCEA"), (4, "za", None), (5, "za", "notice notice period period")]
    q = spark.createDataFrame(asked, "query_id bigint, jurisdiction string, text string")
    syn = spark.createDataFrame(
        [("za", "BCEA", ["Basic Conditions of Employment Act"]), ("za", "bcea", ["act 75", None]), ("za", "notice period", ["period of notice"]),
         ("za", "Employment Act", ["EA"]), ("za", "basic conditions OF employment act", ["BCEA"]), ("za", "period", ["term"]), ("za", " - ", ["none"])],
        "jurisdiction string, alias string, expansions array<string>",
    )
    got = {}
    for r in un.expand_queries(q, syn).orderBy("variant_no").collect():
        got.setdefault(r.query_id, []).append(r.text)
    assert got == {
        1: ["BCEA notice period", "Basic Conditions of Employment Act notice period", "act 75 notice period", "bcea period of notice"],
        2: [asked[1][2], "the BCEA and bcea again", "the basic conditions of employment act and Basic Conditions of Employment Act again",
            "the basic conditions of employment act and act 75 again"],
        3: ["BCEA"],
        4: [None],
        5: ["notice notice period period", "notice notice period term", "notice period of notice period"],
    }


def test_parts_of_a_question_keep_joined_nouns(spark):
    from codicil.operators import understanding as un

    q = spark.createDataFrame([(1, "What are health and safety duties, and who pays? Bread and butter\nWas gilt und wer zahlt")], "query_id bigint, text string")
    assert [r.text for r in un.decompose(q).orderBy("part_no").collect()] == [
        "What are health and safety duties", "who pays", "Bread and butter", "Was gilt", "wer zahlt"
    ]


def test_a_section_of_an_act_that_is_not_cited(spark):
    claims = vf.split_claims(spark.createDataFrame(
        [(1, 1, "Dismissal under s 37(1) and s 145 needs notice [1]."), (2, 1, "s 37 and s 145 [1][2]."), (3, 1, "s 9 [1]."), (4, 1, "s 37 needs no cite.")],
        "query_id bigint, attempt int, text string",
    ))
    held = spark.createDataFrame(
        [(q, n, act, no) for q in (1, 2, 3, 4) for n, act, no in ((1, "lra", "145"), (2, "bcea", "37"), (3, "bcea", "145"))],
        "query_id bigint, n bigint, act string, section_no string",
    )
    got = {(r.query_id, r.ref, *r.cited_acts, "|", *r.held_by) for r in vf.blended_refs(claims, held).collect()}
    assert got == {(1, "37(1)", "lra", "|", "bcea"), (4, "37", "|", "bcea")}


def test_cache_chains_of_any_length_take_few_rounds(spark, monkeypatch):
    import datetime as dt

    from codicil.operators import understanding as un

    hour, start = 3_600_000_000, dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    draw = random.Random(11)
    times = {"hot": sorted(draw.sample(range(0, 900 * 24), 4000)), "daily": [24 * k for k in range(700)], "one": [5], "gaps": [0, 23, 24, 4000, 4023, 9000]}
    rows = [(k, "za", start + dt.timedelta(hours=t)) for k, ts in times.items() for t in ts]
    rounds, real = [], un.stage
    monkeypatch.setattr(un, "stage", lambda df, name, *a: rounds.append(name) or real(df, name, *a))
    got = {}
    for r in un.cache_hits(spark.createDataFrame(rows, "key string, jurisdiction string, ts timestamp")).collect():
        if r.misses:
            got.setdefault(r.key, []).append((r.us - int(start.timestamp()) * 1_000_000) // hour)
    want = {}
    for key, ts in times.items():
        until = None
        for t in ts:
            if until is None or t >= until:
                want.setdefault(key, []).append(t)
                until = t + 24
    assert {k: sorted(v) for k, v in got.items()} == want
    assert rounds.count("reached") <= 12
