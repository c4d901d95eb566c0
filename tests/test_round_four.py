"""Steps whose cost must follow the input: running windows, tasks of bounded pairs, one pass over texts."""

import random
import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from codicil.functions.relational import fresh_path
from codicil.llm import toxicity as tx
from codicil.operators import indexing as ix
from codicil.operators import retrieval as rt
from codicil.operators import understanding as un
from codicil.operators import verification as vf
from codicil.plans import drafts

SMALL = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_next_requests_run_once_over_their_groups(spark):
    """a frame up to the end of a group is computed anew for each of its rows."""
    random.seed(5)
    times = sorted({("a" if random.random() < 0.7 else "b", random.randrange(0, 900_000)) for _ in range(400)})
    for after in (1, 7, 5_000, 60_000, 2_000_000):
        found = un.next_requests(spark.createDataFrame(times, "key string, us long"), after)
        assert "unboundedfollowing" not in optimized(found).lower()
        want = {(k, u): min((v for q, v in times if q == k and v >= u + after), default=None) for k, u in times}
        assert {(r["key"], r["us"]): r["next"] for r in found.collect()} == want


def test_bm25_deals_pairs_over_enough_tasks(spark, monkeypatch):
    """F7 to F17, F21: the number of scoring tasks follows the number of pairs, not the bytes of the postings."""
    random.seed(6)
    words = ["law", "tax", "duty", "court", "act", "sale"]
    texts = [(i, "all", " ".join(random.choices(words, k=6))) for i in range(60)] + [(60, "all", None), (61, "all", "")]
    chunks = spark.createDataFrame(texts, "chunk_id long, jurisdiction string, text string")
    asked = spark.createDataFrame(
        [(q, "all", " ".join(words)) for q in range(5)] + [(5, "all", None)], "query_id long, jurisdiction string, text string"
    )
    want = sorted(map(tuple, rt.bm25(chunks, asked, 10).collect()))
    pairs = 5 * sum(len(set(t.split())) for _, _, t in texts if t)
    monkeypatch.setattr(rt, "PAIRS_A_TASK", 20)
    ranked = rt.bm25(chunks, asked, 10)
    assert f", {-(-pairs // 20)}), REPARTITION_BY_NUM" in ranked._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, ranked.collect())) == want and len(want) == 50
    none = spark.createDataFrame([(1, "all", "unheard")], "query_id long, jurisdiction string, text string")
    assert rt.bm25(chunks, none).count() == 0


def test_stored_terms_come_from_stored_postings(spark):
    """the texts are not cut into terms again for the document frequencies."""
    chunks = spark.createDataFrame(
        [(1, "gb", "tax law law"), (2, "gb", "tax"), (3, "de", "tax"), (4, "gb", None)], "chunk_id long, jurisdiction string, text string"
    )
    index, path = ix.build_index(chunks), fresh_path(spark, "index")
    ix.write_index(ix.TextIndex(index.postings, None, index.stats), path, buckets=4)
    stored = ix.read_index(spark, path, buckets=4)
    rows = {(r["jurisdiction"], r["term"]): r["df"] for r in stored.terms.collect()}
    assert rows == {("gb", "tax"): 2, ("gb", "law"): 1, ("de", "tax"): 1}
    empty = fresh_path(spark, "index")
    ix.write_index(ix.build_index(chunks.where("false")), empty)


def test_needed_conditions_hold_wherever_an_abbreviation_matches():
    """a pattern may be left out only where it changes nothing."""
    plain = lambda p: p.replace(r"\p{L}", "a-zA-ZÉé").replace(r"\p{N}", "0-9").replace(r"\p{Lu}", "[A-ZÉ]").replace(r"\p{Ll}", "[a-zé]")
    grouped = lambda p: re.sub(r"\(\?i:([^()]*)\)", lambda m: f"(?i:{m[1]})", plain(p))
    random.seed(7)
    atoms = ["s", "S", "No", "i.e", "e.g", "z.B", "d.h", "v", "vs", "etc", "resp", "cf", "A", "B", "É", "x", "5", "(3)", ".", ".", " ", "  ", "\t", ", "]
    met = [0] * 4
    for _ in range(20_000):
        line = "".join(random.choices(atoms, k=12))
        for n, (pattern, needed) in enumerate(zip((vf.SHORT, *vf.INSIDE), vf.NEEDED, strict=True)):
            if re.search(grouped(pattern), line):
                met[n] += 1
                assert re.search(plain(needed), line), line
    assert min(met) > 3


def test_claims_of_many_lines_and_abbreviations(spark):
    text = "See s. 5 [1].\n\nNo. (3) holds etc. and so on. J. Smith v. Jones!  \tNext\x0bline [2][1]\r\nend z.B. x. "
    rows = vf.split_claims(spark.createDataFrame([(1, 1, text), (2, 1, None), (3, 1, "")], "query_id long, attempt int, text string"))
    assert [(r["claim_no"], r["claim"], r["cited"]) for r in rows.orderBy("claim_no").collect()] == [
        (0, "See s. 5 [1].", [1]),
        (1, "No. (3) holds etc. and so on.", []),
        (2, "J. Smith v. Jones!", []),
        (3, "Next line [2][1]", [1, 2]),
        (4, "end z.B. x.", []),
    ]


def test_lines_are_cleaned_and_references_found_once(spark):
    """F3 to F6, F18 to F20: drafts clean a line once for both attempts; no filter finds the references a second time."""
    assert optimized(drafts.answers(spark, SMALL)).count("regexp_replace(") == 1
    claims = spark.createDataFrame([(1, 1, 0, "Duties under s 12.", [1])], "query_id long, attempt int, claim_no int, claim string, cited array<long>")
    held = spark.createDataFrame([(1, 1, "3", "See s 3")], "query_id long, n long, section_no string, text string")
    found = vf.section_realism(claims, held)
    assert optimized(found).count(vf.INNER_OF) == optimized(claims.select(vf.inner_refs_of(F.col("claim")).alias("r"))).count(vf.INNER_OF)
    assert [r["ref"] for r in found.collect()] == ["12"]


def test_needed_conditions_hold_wherever_a_reference_matches(spark):
    """a search may be left out only where it finds nothing."""
    random.seed(11)
    heads = (vf.ONE + "|" + vf.MANY + "|" + vf.INNER).split("|")
    atoms = [*heads, *map(str.upper, heads), "x", "5", "12A", "(3)", ".", " ", " ", ",", " to ", "of s 7", "\n"]
    texts = ["".join(random.choices(atoms, k=8)) for _ in range(6_000)] + [f"{h}{m}{n}" for h in heads for m in ("", ".", " ", ". ") for n in ("5", "(3)", "5 and 6", "3 of s 9")]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for patterns, needed in (((vf.REF_LIST,), vf.LIST_NEEDED), ((vf.INNER_REF, vf.INNER_OF), vf.INNER_NEEDED)):
        found = rows.where(F.greatest(*[F.col("text").rlike(p) for p in patterns]) if len(patterns) > 1 else F.col("text").rlike(patterns[0]))
        assert found.count() > 50 and found.where(~F.col("text").rlike(needed)).count() == 0
        assert rows.where(~F.col("text").rlike(needed)).count() > 1_000


def test_sentences_are_cut_as_by_line_and_mark(spark):
    """one cut of the whole text gives the pieces of the cut by lines and then by marks."""
    random.seed(12)
    atoms = ["a", "B.", "s.", "No.", "etc.", "x", "5", "!", "?", ".", " ", "  ", "\t", "\n", "\n\n", "\r", "\x0b", "[1]", vf.HELD]
    texts = ["".join(random.choices(atoms, k=14)) for _ in range(3_000)]
    rows = spark.createDataFrame([(n, 1, t) for n, t in enumerate(texts)], "query_id long, attempt int, text string")
    lines = F.filter(F.split("text", "\n"), lambda l: l != "")
    for pattern in (vf.SHORT, *vf.INSIDE):
        lines = vf._where_needed(lines, "", lambda l, p=pattern: F.regexp_replace(l, p, f"$1$2.{vf.HELD}$3"))
    cut = F.flatten(F.transform(lines, lambda l: F.split(F.regexp_replace(l, r"([.!?])\s+", "$1\n"), "\n")))
    parts = F.transform(F.filter(F.transform(cut, lambda p: F.replace(p, F.lit(vf.HELD), F.lit(" "))), lambda p: p.rlike(r"[\p{L}\p{N}]")), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    want = rows.select("query_id", F.posexplode(parts).alias("no", "claim"))
    assert sorted(map(tuple, vf.split_claims(rows).select("query_id", "claim_no", "claim").collect())) == sorted(map(tuple, want.collect()))
    assert "flatten(" not in optimized(vf.split_claims(rows))


def test_excerpts_are_cut_into_words_before_claims_meet_them(spark):
    """an excerpt that many claims cite is cut once; a claim with two cites is no other verdict."""
    claims = spark.createDataFrame(
        [(1, 1, 0, "The tax is 5 [1][2].", [1, 2]), (1, 1, 1, "The tax is 7 [1].", [1]), (1, 2, 0, "Other words [9].", [9]), (1, 2, 1, "No cite.", [])],
        "query_id long, attempt int, claim_no int, claim string, cited array<long>",
    )
    held = spark.createDataFrame([(1, 1, "the tax is 5"), (1, 2, None)], "query_id long, n long, text string")
    found = vf.entail(claims, held)
    plan = optimized(found)
    assert plan.index("Join") < plan.index("split(lower(text")
    assert [r["verdict"] for r in found.orderBy("attempt", "claim_no").collect()] == ["entailed", "not_entailed", "not_found", "not_found"]


def test_references_are_found_once_for_rate_and_check(spark):
    """the staged claims hold their references; the check does not search the texts again."""
    claims = spark.createDataFrame([(1, 1, 0, "Duties under ss 3, 12 to 15 and subsection (4) [1].", [1])], "query_id long, attempt int, claim_no int, claim string, cited array<long>")
    held = spark.createDataFrame([(1, 1, "3", "See s 3")], "query_id long, n long, section_no string, text string")
    known = vf.with_refs(claims).localCheckpoint()
    again = vf.section_realism(known, held)
    assert vf.REF_LIST not in optimized(again) and vf.INNER_REF not in optimized(again)
    want = sorted(map(tuple, vf.section_realism(claims, held).collect()))
    assert sorted(map(tuple, again.collect())) == want and {w[-1] for w in want} == {"12", "15", "13 to 14", "(4)"}


def test_training_words_meet_landmarks_some_at_a_time():
    """pipeline: the driver holds no table of all subsequences times all words; the kernels are the same to the bit."""
    random.seed(13)
    word = lambda: "".join(random.choices("etaoinshrdlucmfwypvbgk", k=random.randint(4, 12)))
    insults, plain = ([*{word(): 0 for _ in range(n)}] for n in (1_500, 4_000))
    whole = tx.LandmarkKernel(insults[:150])
    assert np.array_equal(tx.gram_of(insults[:150]), whole(insults[:150]))
    parts = [values for _, values in whole.portions(plain[:2_500])]
    assert len(parts) == 3 and np.array_equal(np.vstack(parts), whole(plain[:2_500]))
    tracemalloc.start()
    tx.fit_words(insults, plain)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6, peak
