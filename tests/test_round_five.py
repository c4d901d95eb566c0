"""Claims and excerpts meet once: what is shuffled and staged when drafted answers are checked."""

import random
import re

from pyspark.sql import functions as F

from codicil.operators import verification as vf
from codicil.plans import grounding_queries as gq
from tests.conftest import SMALL

CLAIMS = "query_id long, attempt int, claim_no int, claim string, cited array<long>"
HELD = "query_id long, n int, act string, section_no string, text string"


def drawn(spark, seed):
    """Claims and excerpts with null keys, repeated excerpts, repeated claims and claims of one number with two texts."""
    draw = random.Random(seed)
    ids, marks = [None, 1, 2, 3, 4], ["s 5", "s 7(1)", "ss 3, 5 to 9", "subsection (2)", "paragraph 4 of s 5", "no part", "word 12"]
    claims = [
        (draw.choice(ids), draw.randint(1, 2), draw.randint(0, 5), f"Tax {draw.choice(marks)} and {draw.choice(marks)}", draw.sample(range(1, 7), draw.randint(0, 3)))
        for _ in range(120)
    ]
    held = [
        (draw.choice(ids), draw.choice([None, 1, 2, 3, 4]), draw.choice(["a", "b", None]), draw.choice(["5", "7", None]),
         draw.choice([None, "", "Tax s 5 and s 7 (1)", "tax (2)(a) and 12", "not word 12 no part 6", "Tax Tax s 5 and word 12 (4)"]))
        for _ in range(40)
    ]
    return claims + claims[:20], held + held[:10], spark.createDataFrame(claims + claims[:20], CLAIMS), spark.createDataFrame(held + held[:10], HELD)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (\w+)\(([^)]*)\)", plan)


def test_evidence_is_every_cited_excerpt(spark):
    """one row of excerpts a question gives the pairs of a join on question and number."""
    claims, held, c, e = drawn(spark, 21)
    got = sorted(map(repr, map(tuple, vf.evidence(c, e).select("query_id", "attempt", "claim_no", "claim", "cited", "n", "act", "section_no", "text").collect())))
    want = []
    for q, a, k, text, cited in claims:
        for n in cited or [None]:
            met = [h[2:] for h in held if None not in (q, n) and h[:2] == (q, n)] or [(None,) * 3]
            want += [repr((q, a, k, text, cited, n, *m)) for m in met]
    assert got == sorted(want)


def test_claims_and_excerpts_are_shuffled_once(spark):
    """verdicts and their routes need two shuffles, both by question; a check of sections shuffles no text."""
    _, _, c, e = drawn(spark, 22)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (vf.entail(c, e), vf.route_claims(vf.entail(c, e)), vf.section_realism(c, e), vf.blended_acts(c, e)):
            kinds = exchanges(found)
            assert len(kinds) == 2 and {k for k, _ in kinds} == {"hashpartitioning"}, kinds
            assert all(re.fullmatch(r"(query_id|__of)#\d+L, \d+", by) for _, by in kinds), kinds
        plan = vf.section_realism(c, e)._jdf.queryExecution().optimizedPlan().toString()
        dealt = [line for line in re.split(r"(?=RepartitionByExpression)", plan)[1:]]
        assert len(dealt) == 2
        for part in dealt:
            below = next(line for line in part.splitlines() if "Project [" in line)
            assert not re.search(r"[\[ ](claim|text)#\d+[,\]]", below.split("Project", 1)[1]), below
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sections_are_checked_on_verdicts_with_marks(spark):
    """claims that met their excerpts for a verdict are not joined with them again, and lose no reference."""
    for seed in (23, 24):
        _, _, c, e = drawn(spark, seed)
        judged = vf.with_refs(vf.entail(c, e, marks=True))
        assert sorted(map(repr, judged.select(*vf.CLAIM, "claim", "cited", "verdict").collect())) == sorted(map(repr, vf.entail(c, e).collect()))
        known = judged.drop("claim", "cited").localCheckpoint()
        again = vf.section_realism(known, e)
        assert "Join" not in again._jdf.queryExecution().optimizedPlan().toString()
        want = sorted(map(repr, vf.section_realism(c, e).collect()))
        assert sorted(map(repr, again.collect())) == want and len(want) > 20


def test_bracketed_parts_stand_for_the_text(spark):
    """a part is in the text if it is in one of its runs of bracketed parts."""
    draw = random.Random(25)
    atoms = ["(1)", "(a)", "(2B)", "(", ")", "1", "a", " ", "()", "(1", "é"]
    texts = ["".join(draw.choices(atoms, k=9)) for _ in range(2_000)]
    sought = ["(1)", "(a)", "(1)(a)", "(2B)(1)", "(1)(1)(a)"]
    rows = vf.section_marks(spark.createDataFrame([(t,) for t in texts], "text string")).select("text", "parts").collect()
    pairs = [(p in row["parts"], p in row["text"]) for row in rows for p in sought]
    assert all(a == b for a, b in pairs) and sum(b for _, b in pairs) > 500


def test_attempts_stage_no_claims(spark, monkeypatch):
    """of the staged claims only those keep their text that no excerpt supports, and none its citations."""
    staged = []

    def kept(df, name, by=None, write=gq.stage):
        staged.append(write(df, name, by))
        return staged[-1]

    monkeypatch.setattr(gq, "stage", kept)
    assert gq.statuses(spark, SMALL).count() > 0
    assert [sorted(s.columns) for s in staged] == [["attempt", "claim", "claim_no", "marks", "query_id", "ranges", "refs", "verdict"]]
    assert staged[0].where((F.col("verdict") != "not_found") & F.col("claim").isNotNull()).count() == 0
    assert staged[0].where((F.col("verdict") == "not_found") & F.col("claim").isNull()).count() == 0
