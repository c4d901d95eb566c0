"""Grounding checks on drafted answers (V-01 .. V-14).

Shapes: answers (query_id, attempt, text); excerpts (query_id, n, act,
section_no, text, as_at, status); claims (query_id, attempt, claim_no, claim,
cited array<bigint>). Groups are one claim or one answer, bounded by its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.relational import join_hot, small_side, stage
from codicil.functions.text import squash, tokens

CITE = r"\[([0-9]+)\]"
NUMBER = r"[0-9]+(?:\.[0-9]+)*[A-Za-z]?(?:\([0-9a-z]+\))*"
# Heads of a section reference. One number follows a singular head, a list of them a plural one.
ONE = r"s|sec|section|art|article|reg|regulation|§"
MANY = r"ss|secs|sections|arts|articles|regs|regulations|§§"
TO = r"(?: (?:to|through|bis|à) | ?[–-] ?)"
JOIN = rf"(?: ?, ?(?:(?:and|or|und|et|y) )?| (?:and|or|und|oder|et|ou|y|&) |{TO})"
REF = rf"(?:^|[^\p{{L}}\p{{N}}])(?i:{ONE})\.? ?({NUMBER})"
REF_LIST = rf"(?:^|[^\p{{L}}\p{{N}}])(?i:{MANY})\.? ?({NUMBER}(?:{JOIN}{NUMBER})*)"
PAIR = rf"([0-9]+)[A-Za-z]?{TO}([0-9]+)"
# Heads of a part of a section, alone or followed by its section.
INNER = r"subsection|sub-section|subs|paragraph|para|subparagraph|absatz|abs"
PLACE = r"(?:\([0-9a-zA-Z]{1,3}\)|[0-9]+[A-Za-z]?)(?![\p{L}\p{N}])"
WITHIN = rf" (?i:of|des|der|von) (?i:{ONE})\.? ?([0-9]+[A-Za-z]?)"
INNER_REF = rf"(?:^|[^\p{{L}}\p{{N}}])(?i:{INNER})\.? ?({PLACE})(?!{WITHIN})"
INNER_OF = rf"(?:^|[^\p{{L}}\p{{N}}])(?i:{INNER})\.? ?({PLACE}){WITHIN}"
# Abbreviations whose dot before a number does not end a sentence.
SHORT = r"(^|[^\p{L}\p{N}])((?i:s|ss|sec|secs|art|arts|reg|regs|no|nos|nr|abs|para|paras|cl|ch))\.[ \t]+([0-9(])"
# Abbreviations whose dot never ends a sentence, one that does before a capital only, and initials before a name.
INSIDE = (
    r"(^|[^\p{L}\p{N}])((?i:vs?|i\.e|e\.g|cf|resp|z\.B|d\.h))\.[ \t]+(\S)",
    r"(^|[^\p{L}\p{N}])((?i:etc))\.[ \t]+(\p{Ll})",
    r"(^|[^\p{L}\p{N}])(\p{Lu})\.[ \t]+(\p{Lu})",
)
HELD = "\ue000"
# What a line must hold for each of these to apply, in the same order: found by its dots, without a look at every letter.
NEEDED = (r"\.[ \t]+[0-9(]", r"[vsegfpbhVSEGFPBH]\.[ \t]+\S", r"[cC]\.[ \t]+\p{Ll}", r"\p{Lu}\.[ \t]+\p{Lu}")
#: What a text must hold for a list of references, or a part of a section: the end of a head right before a digit or bracket.
LIST_NEEDED = r"[0-9](?<=(?i:[sctegn]s|§§)\.? ?[0-9])"
INNER_NEEDED = r"[0-9(](?<=(?i:on|bs|ph|ra|tz)\.? ?[0-9(])"
#: A sentence's end: white space right after its mark, or a line end.
SENTENCE_END = r"\n|\s(?<=[.!?]\s)\s*"
#: Parts of a section in brackets, one after the other; what a reference has after its number is such a run.
PARTS = r"(?:\([0-9a-zA-Z]+\))+"
NUMBERED = r"(?:^|[^\p{L}\p{N}])([0-9]+[A-Za-z]?(?:\([0-9a-z]+\))*)"

# Words that negate a statement.
NEGATIONS = ("not", "no", "never", "nicht", "kein", "pas", "jamais", "nunca")
# Phrases that claim precedence, and the words they are demoted to.
CONTROLLING = r"(?i)(the )?(controlling provision|governing provision|prevailing provision)( is)?"
DEMOTED = "most relevant retrieved (verify before relying):"


def none_() -> Column:
    return F.array().cast("array<string>")


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def cites_of(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(CITE), F.lit(1)), lambda n: n.try_cast("bigint"))
    return _once(found, lambda ns: F.when(F.size(ns) > 1, F.array_sort(F.array_distinct(ns))).otherwise(ns))


def _lists_of(text: Column) -> Column:
    """Lists of section numbers after a plural head."""
    found = F.regexp_extract_all(text, F.lit(REF_LIST), F.lit(1))
    return F.when(text.rlike(LIST_NEEDED), found).when(text.isNotNull(), none_())


def refs_of(text: Column) -> Column:
    """Section numbers referred to, alone or in a list after a plural head; of a range, both ends."""
    listed = F.flatten(F.transform(_lists_of(text), lambda l: F.regexp_extract_all(l, F.lit(NUMBER), F.lit(0))))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(REF), F.lit(1)), listed))


def ranges_of(text: Column) -> Column:
    """Ranges of section numbers as (low, high), alone or inside a list: ``ss 5 to 9``, ``§§ 3, 5–9``."""
    pairs = F.flatten(F.transform(_lists_of(text), lambda l: F.regexp_extract_all(l, F.lit(PAIR), F.lit(0))))
    end = lambda p, g: F.regexp_extract(p, PAIR, g).try_cast("bigint")
    ends = F.transform(pairs, lambda p: F.struct(end(p, 1).alias("low"), end(p, 2).alias("high")))
    return F.array_distinct(F.filter(ends, lambda r: r["low"] < r["high"]))


def inner_refs_of(text: Column) -> Column:
    """Parts of a section: ``5(3)`` where the section is named with it, else the part alone, ``(3)``."""
    bare = lambda m, pattern: F.concat(
        F.lit("("), F.regexp_replace(F.regexp_extract(m, pattern, 1), "[()]", ""), F.lit(")")
    )
    named = F.transform(
        F.regexp_extract_all(text, F.lit(INNER_OF), F.lit(0)),
        lambda m: F.concat(F.regexp_extract(m, INNER_OF, 2), bare(m, INNER_OF)),
    )
    alone = F.transform(F.regexp_extract_all(text, F.lit(INNER_REF), F.lit(0)), lambda m: bare(m, INNER_REF))
    found = F.array_distinct(F.concat(named, alone))
    return F.when(text.rlike(INNER_NEEDED), found).when(text.isNotNull(), none_())


def section_order(no: Column) -> Column:
    """Sort key of a section number: 12 before 12A before 13."""
    return F.struct(section_int(no).alias("number"), F.upper(F.regexp_extract(no, r"^[0-9]+([A-Za-z]*)", 1)).alias("suffix"))


def section_int(no: Column) -> Column:
    return F.regexp_extract(no, r"^([0-9]+)", 1).try_cast("bigint")


def gaps_between(low: Column, high: Column, held: Column) -> Column:
    """Runs strictly inside (low, high) without a held number, as ``6 to 8`` or ``7``; ``held`` is any array of numbers."""
    inside = F.array_sort(F.array_distinct(F.filter(held, lambda h: (h > low) & (h < high))))
    stops = F.concat(inside, F.array(high))
    runs = F.transform(
        stops,
        lambda stop, k: F.struct(
            (F.when(k == 0, low).otherwise(F.get(inside, k - 1)) + 1).alias("first"), (stop - 1).alias("last")
        ),
    )
    name = lambda r: F.when(r["first"] == r["last"], r["first"].cast("string")).otherwise(
        F.concat(r["first"].cast("string"), F.lit(" to "), r["last"].cast("string"))
    )
    return F.transform(F.filter(runs, lambda r: r["first"] <= r["last"]), name)


def _where_needed(texts: Column, needed: str, change) -> Column:
    """``change`` of the texts that hold ``needed``, a cheap condition without which it changes nothing."""
    return F.transform(texts, lambda t: F.when(t.rlike(needed), change(t)).otherwise(t))


def split_claims(answers: DataFrame) -> DataFrame:
    """V-03. Sentences with the excerpts they cite; cut at sentence and line ends.

    No cut follows "s." or "No." before a number, "v.", "i.e.", or an initial before a name.
    Line ends cut, so abbreviations are sought in single lines, and only in texts with a dot before a blank.
    """
    lines = F.split("text", "\n")
    for pattern, needed in zip((SHORT, *INSIDE), NEEDED, strict=True):
        lines = _where_needed(lines, needed, lambda l, p=pattern: F.regexp_replace(l, p, f"$1$2.{HELD}$3"))
    dotted = F.contains("text", F.lit(". ")) | F.contains("text", F.lit(".\t"))
    cut = F.split(F.when(dotted, F.array_join(lines, "\n")).otherwise(F.col("text")), SENTENCE_END)
    cut = F.filter(F.transform(cut, lambda p: F.replace(p, F.lit(HELD), F.lit(" "))), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    # Single blanks stay as they are; only longer runs and other white space are replaced.
    ragged = lambda p: F.contains(p, F.lit("  ")) | p.rlike(r"[\t\n\x0B\f\r]")
    squashed = lambda p: F.regexp_replace(p, r"\s(?:\s+|(?<! ))", " ")
    parts = F.transform(cut, lambda p: F.trim(F.when(ragged(p), squashed(p)).otherwise(p)))
    return (
        answers.select("query_id", "attempt", F.posexplode_outer(parts).alias("claim_no", "claim"))
        .where(F.col("claim").isNotNull())
        .withColumn("cited", cites_of(F.col("claim")))
    )


def citation_realism(answers: DataFrame, excerpts: DataFrame) -> DataFrame:
    """V-01. Citations without an excerpt; an answer that cites nothing gets one row with null."""
    cited = answers.select("query_id", "attempt", F.explode_outer(cites_of(F.col("text"))).alias("n"))
    real = excerpts.select("query_id", F.col("n").cast("bigint").alias("n"))
    return cited.join(real, ["query_id", "n"], "left_anti").select("query_id", "attempt", "n")


def evidence(claims: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Each claim with each excerpt it cites; a claim without one keeps a row of nulls.

    Both are dealt by question and each text is shuffled once; groups by claim,
    attempt or question that follow need no shuffle. Numbers are compared among a
    question's excerpts, since an equality would be a second key to deal by.
    """
    held = excerpts.withColumns({"__of": F.col("query_id"), "__n": F.col("n").cast("bigint")}).drop("query_id", "n")
    cited = claims.repartition("query_id").withColumn("n", F.explode_outer("cited"))
    same = (F.col("query_id") == F.col("__of")) & (F.col("n") <= F.col("__n")) & (F.col("n") >= F.col("__n"))
    return cited.join(held.repartition("__of"), same, "left").drop("__of", "__n")


CLAIM = ["query_id", "attempt", "claim_no"]


def with_refs(claims: DataFrame) -> DataFrame:
    """Claims with what they refer to: ``named`` sections, ``refs`` (these and parts of sections) and ``ranges``."""
    return claims.withColumns({"named": refs_of(F.col("claim")), "ranges": ranges_of(F.col("claim"))}).withColumn(
        "refs", F.array_union("named", inner_refs_of(F.col("claim")))
    )


def section_marks(excerpts: DataFrame) -> DataFrame:
    """Excerpts with what a reference is sought in: the numbers of their text and its runs of bracketed parts, ``(1)(a)``."""
    return excerpts.withColumns({
        "numbered": F.array_join(F.regexp_extract_all("text", F.lit(NUMBERED), F.lit(1)), " "),
        "parts": F.array_join(F.regexp_extract_all("text", F.lit(PARTS), F.lit(0)), " "),
    })


MARKS = ["section_no", "numbered", "parts"]


def section_realism(claims: DataFrame, excerpts: DataFrame) -> DataFrame:
    """V-02. Section references that no excerpt cited by the claim holds.

    A reference is held if it is the excerpt's section, if its stem is and the
    text has the rest, or if it stands in the text as a whole number. A part named
    without its section (``subsection (3)``) is sought in the sections of the cited
    excerpts. Of a range the ends are references, and the numbers between them
    that no cited excerpt holds are given as runs, such as ``6 to 8``. Claims that
    come from ``with_refs`` keep the references found there, and those that come
    from ``entail`` with ``marks`` have met their excerpts. Texts are not shuffled:
    a reference needs the section, numbers and bracketed parts of an excerpt only.
    """
    known = {"refs", "ranges"} <= set(claims.columns)
    if "marks" in claims.columns:
        refs = (claims.where(F.size("refs") > 0) if known else with_refs(claims)).select(*CLAIM, "refs", "ranges", F.explode_outer("marks").alias("m"))
        paired = refs.select(*CLAIM, "refs", "ranges", "m.*")
    else:
        # A filter on refs would run below them and find them twice; every reference holds a digit or a bracket.
        refs = claims.where(F.col("claim").rlike("[0-9(]"))
        paired = evidence(refs if known else with_refs(refs), section_marks(excerpts).select("query_id", "n", *MARKS))
    paired = paired.withColumn("in_text", F.split("numbered", " "))

    def held(r: Column) -> Column:
        stem = F.regexp_extract(r, r"^([0-9]+(?:\.[0-9]+)*[A-Za-z]?)", 1)
        rest = F.substring(r, F.length(stem) + 1, F.length(r))
        part = F.regexp_extract(r, r"^\(([0-9]+)", 1)
        return F.coalesce(
            (r == F.col("section_no"))
            | ((stem == F.col("section_no")) & (rest != "") & F.contains(F.col("parts"), rest))
            | ((stem == "") & (F.contains(F.col("parts"), r) | ((part != "") & F.array_contains("in_text", part))))
            | F.array_contains("in_text", r),
            F.lit(False),
        )

    numbers = F.filter(
        F.concat(
            F.array(section_int(F.col("section_no"))),
            F.transform("in_text", lambda t: F.regexp_extract(t, r"^([0-9]+)(?:\(|$)", 1).try_cast("bigint")),
        ),
        lambda n: n.isNotNull(),
    )
    ok = paired.select(*CLAIM, "refs", "ranges", F.filter("refs", held).alias("ok"), numbers.alias("numbers"))
    whole = ok.groupBy(*CLAIM, "refs").agg(
        F.array_distinct(F.flatten(F.collect_list("ok"))).alias("ok"),
        F.any_value("ranges").alias("ranges"),
        F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers"),
    )
    gaps = F.flatten(F.transform("ranges", lambda r: gaps_between(r["low"], r["high"], F.col("numbers"))))
    return whole.select(
        *CLAIM, F.explode_outer(F.array_union(F.array_except("refs", "ok"), gaps)).alias("ref")
    ).where(F.col("ref").isNotNull())


def claim_body(claim: Column) -> Column:
    """Claim words without citations and section references."""
    unlisted = lambda c: F.when(c.rlike(LIST_NEEDED), F.regexp_replace(c, REF_LIST, " ")).otherwise(c)
    return F.regexp_replace(_once(F.regexp_replace(claim, CITE, " "), unlisted), REF, " ")


def lexical_support(share: float = 0.5) -> Column:
    """Default verdict of one claim against one excerpt, over c_terms, e_toks and ``lost``, the terms not in e_toks.

    A lexical stand-in: it compares words, numbers and negation and cannot see
    real entailment.
    """
    n = F.size("c_terms")
    known = F.when(n > 0, (n - F.size("lost")) / n).otherwise(F.lit(0.0))
    no = F.array(*[F.lit(w) for w in NEGATIONS])
    differs = F.exists("lost", lambda t: t.rlike("^[0-9]+$")) | (
        F.arrays_overlap("c_terms", no) != F.arrays_overlap("e_toks", no)
    )
    return (
        F.when(F.col("e_toks").isNull() | (known < share), "not_found").when(differs, "not_entailed").otherwise("entailed")
    )


def entail(claims: DataFrame, excerpts: DataFrame, scorer: Column | None = None, marks: bool = False) -> DataFrame:
    """V-04. Verdict per claim: the best over its cited excerpts.

    ``scorer`` is any column (a pandas UDF included) over claim, text, c_terms
    and e_toks that gives a verdict. An excerpt's words are cut once, before the
    claims that cite it meet them; they travel as one string, and without a scorer
    each once and without the text. With ``marks`` a claim also gets the marks of the
    excerpts it cites, for ``section_realism``.
    """
    words = tokens("text") if scorer is not None else F.array_distinct(tokens("text"))
    held = section_marks(excerpts) if marks else excerpts
    held = held.select("query_id", "n", F.array_join(words, " ").alias("words"), *(["text"] if scorer is not None else []), *(MARKS if marks else []))
    paired = evidence(claims, held).withColumns({
        "c_terms": F.array_distinct(tokens(claim_body(F.col("claim")))),
        "e_toks": F.array_remove(F.split("words", " "), ""),
    }).withColumn("lost", F.array_except("c_terms", "e_toks"))
    verdict = lexical_support() if scorer is None else scorer
    order = F.when(F.col("v") == "entailed", 2).when(F.col("v") == "not_entailed", 1).otherwise(0)
    best = F.when(F.col("best") == 2, "entailed").when(F.col("best") == 1, "not_entailed").otherwise("not_found")
    return (
        paired.withColumn("v", verdict)
        .groupBy(*CLAIM, "claim", "cited")
        .agg(F.max(order).alias("best"), *([F.collect_list(F.struct(*MARKS)).alias("marks")] if marks else []))
        .select(*CLAIM, "claim", "cited", best.alias("verdict"), *(["marks"] if marks else []))
    )


def route_claims(verdicts: DataFrame, nli_mode: str = "blocking") -> DataFrame:
    """V-05. Unfound claims become gaps; an unentailed one fails the attempt; only gaps refuse it."""
    if nli_mode not in ("blocking", "log_only"):
        raise ValueError("nli_mode must be blocking or log_only")
    v = F.col("verdict")
    gaps = F.array_sort(F.collect_list(F.when(v == "not_found", F.struct("claim_no", "claim"))))
    wrong = F.array_sort(F.collect_list(F.when(v == "not_entailed", F.col("claim_no"))))
    out = verdicts.groupBy("query_id", "attempt").agg(
        F.transform(gaps, lambda g: g["claim"]).alias("gaps"),
        wrong.alias("failed_claims"),
        F.count_if(v == "entailed").alias("entailed"),
        F.count("*").alias("claims"),
        F.count_if(v == "not_found").alias("unfound"),
        F.count(F.when(v == "not_entailed", F.col("claim_no"))).alias("wrong"),
    )
    # By counts, so that an outcome alone gathers no claims.
    outcome = F.when(F.col("unfound") == F.col("claims"), "refuse")
    if nli_mode == "blocking":
        outcome = outcome.when(F.col("wrong") > 0, "fail")
    return out.withColumn("outcome", outcome.otherwise("pass")).drop("unfound", "wrong")


def cited_excerpts(answers: DataFrame, excerpts: DataFrame) -> DataFrame:
    """The excerpts an attempt cites, each once."""
    cited = answers.select("query_id", "attempt", F.explode_outer(cites_of(F.col("text"))).alias("n"))
    return cited.join(excerpts.withColumn("n", F.col("n").cast("bigint")), ["query_id", "n"])


def currency_line(answers: DataFrame, excerpts: DataFrame) -> DataFrame:
    """V-06. Law stated as at the latest date of the cited excerpts; the earliest is given too."""
    line = F.concat(
        F.lit("Law stated as at "), F.col("as_at_max").cast("string"),
        F.lit("; check for later amendments and commencement."),
    )
    return (
        cited_excerpts(answers, excerpts)
        .groupBy("query_id", "attempt")
        .agg(F.max("as_at").alias("as_at_max"), F.min("as_at").alias("as_at_min"))
        .withColumn("currency", line)
    )


def status_disclosure(answers: DataFrame, excerpts: DataFrame) -> DataFrame:
    """V-07. Cited provisions that are not in force, and whether the answer says so."""
    bad = (
        cited_excerpts(answers, excerpts)
        .where(F.col("status") != "in_force")
        .groupBy("query_id", "attempt")
        .agg(
            F.array_sort(F.collect_set(F.concat_ws(" ", F.lit("s"), "section_no", "status"))).alias("must_disclose"),
            F.array_sort(F.collect_set("status")).alias("statuses"),
        )
    )
    low = F.lower("text")
    told = answers.select(
        "query_id",
        "attempt",
        F.array_compact(F.array(*[F.when(F.contains(low, F.lit(s)), F.lit(s)) for s in ("pending", "repealed")])).alias("told"),
    )
    return bad.join(told, ["query_id", "attempt"]).select(
        "query_id", "attempt", "must_disclose", (F.size(F.array_except("statuses", "told")) == 0).alias("disclosed")
    )


def demote_controlling(claims: DataFrame, excerpts: DataFrame, rules: DataFrame) -> DataFrame:
    """V-08. A claim of precedence stays only if it cites an Act that ``rules`` (act) backs."""
    backed = (
        evidence(claims, excerpts.select("query_id", "n", "act"))
        .join(small_side(rules.select("act").distinct().withColumn("ruled", F.lit(True))), "act", "left")
        .groupBy(*CLAIM, "claim")
        .agg(F.bool_or(F.coalesce("ruled", F.lit(False))).alias("backed"))
    )
    claims_it = F.col("claim").rlike(CONTROLLING)
    return backed.select(
        *CLAIM,
        (claims_it & ~F.col("backed")).alias("demoted"),
        F.when(claims_it & ~F.col("backed"), F.regexp_replace("claim", CONTROLLING, DEMOTED)).otherwise(F.col("claim")).alias("claim"),
    )


def blended_acts(claims: DataFrame, excerpts: DataFrame) -> DataFrame:
    """V-09. Claims that join excerpts of different Acts."""
    return (
        evidence(claims, excerpts.select("query_id", "n", "act"))
        .groupBy(*CLAIM)
        .agg(F.array_sort(F.collect_set("act")).alias("acts"))
        .where(F.size("acts") > 1)
    )


def blended_refs(claims: DataFrame, excerpts: DataFrame) -> DataFrame:
    """V-09. Section references that only an Act the claim does not cite holds: (claim, ref, cited_acts, held_by).

    Each reference meets the sections of all Acts among the question's excerpts;
    it is blended if some Act there holds it and none of the cited ones does.
    """
    refs = claims.select(*CLAIM, F.explode_outer(refs_of(F.col("claim"))).alias("ref")).where(F.col("ref").isNotNull())
    refs = refs.withColumn("section_no", F.regexp_extract("ref", r"^([0-9]+(?:\.[0-9]+)*[A-Za-z]?)", 1))
    held = excerpts.select("query_id", "act", "section_no").where("act IS NOT NULL").groupBy("query_id", "section_no")
    held = held.agg(F.array_sort(F.collect_set("act")).alias("held_by"))
    cited = evidence(claims, excerpts.select("query_id", "n", "act")).groupBy(*CLAIM)
    cited = cited.agg(F.array_sort(F.collect_set("act")).alias("cited_acts"))
    return (
        refs.join(held, ["query_id", "section_no"])
        .join(cited, CLAIM)
        .where(~F.arrays_overlap("held_by", "cited_acts"))
        .select(*CLAIM, "ref", "cited_acts", "held_by")
    )


def attempt_status(answers: DataFrame, *failures: DataFrame) -> DataFrame:
    """Each attempt with its sorted failure reasons; each frame is (query_id, attempt, reason)."""
    pooled = answers.select("query_id", "attempt", F.lit(None).cast("string").alias("reason"))
    for f in failures:
        pooled = pooled.unionByName(f.select("query_id", "attempt", "reason").distinct())
    return (
        pooled.groupBy("query_id", "attempt")
        .agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
        .withColumn("passed", F.size("reasons") == 0)
    )


def repair_or_refuse(attempts: DataFrame) -> DataFrame:
    """V-10. One retry with reasons, then refuse. Over (query_id, attempt <= 2, passed, reasons)."""
    last = F.max(F.struct("attempt", "passed", "reasons"))
    state = attempts.where("attempt <= 2").groupBy("query_id").agg(
        last.alias("l"), F.min(F.when(F.col("passed"), F.col("attempt"))).alias("ok")
    )
    action = (
        F.when(F.col("ok").isNotNull(), "accept").when(F.col("l.attempt") == 1, "repair").otherwise("refuse")
    )
    return state.select(
        "query_id",
        action.alias("action"),
        F.coalesce("ok", "l.attempt").alias("attempt"),
        F.when(F.col("ok").isNull(), F.col("l.reasons")).otherwise(none_()).alias("feedback"),
    )


REFUSALS = {
    "mismatch": "jurisdiction_mismatch",
    "act_missing": "act_not_held",
    "uncovered": "no_coverage",
    "unverified": "verification_failed",
}


def decide(gates: DataFrame) -> DataFrame:
    """V-11. First refusal that applies, in gate order; null flags do not refuse."""
    flags = [(F.coalesce(F.col(c), F.lit(False)), reason) for c, reason in REFUSALS.items()]
    reason = F.coalesce(*[F.when(cond, F.lit(r)) for cond, r in flags])
    told = (
        F.when(F.col("reason") == "jurisdiction_mismatch", F.concat(F.lit("Try jurisdiction "), F.coalesce("suggested_jurisdiction", F.lit("unknown"))))
        .when(F.col("reason") == "act_not_held", F.concat(F.lit("Not held: "), F.coalesce("missing_act", F.lit("the named Act"))))
        .when(F.col("reason") == "no_coverage", F.lit("No supported answer in what was searched"))
        .when(F.col("reason") == "verification_failed", F.lit("The answer could not be verified; see the excerpts"))
    )
    return gates.withColumn("reason", reason).select(
        "query_id", F.col("reason").isNotNull().alias("refused"), "reason", told.alias("explanation")
    )


def cite_format(rows: DataFrame) -> DataFrame:
    """V-12. Citation text by document type, with a case's treatment disclosed."""
    base = (
        F.when(F.col("doc_type") == "case", F.concat_ws(" ", "act", F.concat(F.lit("["), F.col("court"), F.lit("]")), F.concat(F.lit("para "), F.col("section_no"))))
        .when(F.col("doc_type") == "regulation", F.concat_ws(" ", "act", F.lit("reg"), "section_no"))
        .otherwise(F.concat_ws(" ", "act", F.lit("s"), "section_no"))
    )
    warn = F.when((F.col("doc_type") == "case") & (F.col("treatment") != "followed"), F.concat(F.lit(" ("), F.col("treatment"), F.lit(")")))
    return rows.withColumn("citation", F.concat(base, F.coalesce(warn, F.lit(""))))


def _column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def respond(
    decisions: DataFrame, answers: DataFrame, excerpts: DataFrame, provider: str = "codicil", writer: str = "none"
) -> DataFrame:
    """V-13. Response JSON per question with every key of the contract; confidence is the top rerank score.

    ``decisions`` is (query_id, refused, reason) and may name jurisdiction,
    corpus_id and suggested_jurisdiction; ``answers`` is (query_id, text) and may
    hold ``structured``. ``excerpts`` (query_id, n, chunk_id, score) holds at most
    twelve per question; act and section_no, if there, name the sources. A refused
    answer is null, and its reason stands under ``errors``.
    """
    source = F.struct(
        "n", "chunk_id", _column_or_null(excerpts, "act", "string").alias("act"), _column_or_null(excerpts, "section_no", "string").alias("section_no")
    )
    held = excerpts.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "chunk_id"))).alias("results"),
        F.array_sort(F.collect_list(source)).alias("sources"),
        F.max("score").alias("confidence"),
    )
    given = decisions.select(
        "query_id",
        "refused",
        "reason",
        *[_column_or_null(decisions, c, "string").alias(c) for c in ("jurisdiction", "corpus_id", "suggested_jurisdiction")],
    )
    said = answers.select("query_id", F.col("text").alias("answer"), _column_or_null(answers, "structured", "string").alias("structured"))
    both = given.join(said, "query_id", "left").join(held, "query_id", "left")
    open_ = ~F.col("refused")
    shown = both.withColumns(
        {
            "answer": F.when(open_, F.col("answer")),
            "structured": F.when(open_, F.col("structured")),
            "match_count": F.coalesce(F.size("results"), F.lit(0)),
            "grounded": open_ & (F.coalesce(F.size("results"), F.lit(0)) > 0),
            "confidence": F.round("confidence", 6),
            "errors": F.array_compact(F.array(F.when(F.col("refused"), F.col("reason")))),
        }
    )
    none = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType))
    body = F.struct(
        F.lit(provider).alias("provider"),
        "answer",
        "structured",
        none("sources").alias("sources"),
        none("results").alias("results"),
        F.col("match_count").alias("matchCount"),
        "grounded",
        "jurisdiction",
        "corpus_id",
        F.lit(writer).alias("writer"),
        F.col("suggested_jurisdiction").alias("suggestedJurisdiction"),
        "errors",
        "refused",
        "reason",
    )
    return shown.select(
        "query_id", "refused", "reason", "answer", "match_count", "results", "confidence",
        F.to_json(body, {"ignoreNullFields": "false"}).alias("response"),
    )


def sections_in_ranges(ranges: DataFrame, held: DataFrame) -> DataFrame:
    """Each range (act, low, high) with the held sections (act, section_no, live) whose number lies in it.

    An interval join by equal keys: a range is laid over buckets of its own scale,
    the largest power of two within its width, so it meets three buckets at most
    however wide it is; a section stands in one bucket of each scale that occurs.
    """
    scale = F.floor(F.log2(F.col("high") - F.col("low") + 1)).cast("int")
    laid = ranges.select("act", "low", "high").distinct().withColumn("scale", scale)
    scales = [r["scale"] for r in laid.select("scale").distinct().collect()]  # 63 at most, as numbers are 64 bits
    bucket = lambda c: F.floor(F.col(c) / F.pow(F.lit(2), F.col("scale"))).cast("bigint")
    laid = laid.withColumn("bucket", F.explode(F.sequence(bucket("low"), bucket("high"))))
    numbered = held.withColumn("number", section_int(F.col("section_no"))).where("number IS NOT NULL")
    numbered = numbered.withColumn("scale", F.explode(F.lit(scales or [0]))).withColumn("bucket", bucket("number"))
    return laid.join(numbered, ["act", "scale", "bucket"]).where("number BETWEEN low AND high").drop("scale", "bucket")


def range_findings(ranges: DataFrame, live: DataFrame) -> DataFrame:
    """(act, low, high, ref, finding) strictly inside each range: sections out of force, and runs that are not held."""
    asked = ranges.select("act", "low", "high").distinct()
    found = stage(sections_in_ranges(asked, live).where("number > low AND number < high"), "range-sections")
    dead = found.where(~F.col("live")).select("act", "low", "high", F.col("section_no").alias("ref"), F.lit("not_in_force").alias("finding"))
    numbers = found.groupBy("act", "low", "high").agg(F.collect_set("number").alias("numbers"))
    none = F.array().cast("array<bigint>")
    gaps = asked.join(numbers, ["act", "low", "high"], "left").withColumn("numbers", F.coalesce("numbers", none))
    runs = F.explode(gaps_between(F.col("low"), F.col("high"), F.col("numbers")))
    return dead.unionByName(gaps.select("act", "low", "high", runs.alias("ref"), F.lit("not_held").alias("finding")))


def review_documents(drafts: DataFrame, held: DataFrame) -> DataFrame:
    """V-14. Statutory references in client drafts that the corpus lacks or holds out of force.

    ``drafts`` (doc_id, act, text); ``held`` (act, section_no, status). The corpus
    is folded to one row per section before the join. Of a range (``ss 5 to 9``) the
    ends are references; sections between them are found by an interval join, and
    what is not held there is given as runs, such as ``6 to 8``.
    """
    named = drafts.select("doc_id", "act", F.explode_outer(refs_of(F.col("text"))).alias("ref")).where(F.col("ref").isNotNull())
    refs = named.withColumn("section_no", F.regexp_extract("ref", r"^([0-9]+(?:\.[0-9]+)*[A-Za-z]?)", 1))
    live = held.groupBy("act", "section_no").agg(F.bool_or(F.col("status") == "in_force").alias("live"))
    single = (
        join_hot(refs, live, ["act", "section_no"], "doc_id", "left")
        .withColumn("finding", F.when(F.col("live").isNull(), "not_held").when(~F.col("live"), "not_in_force"))
        .where(F.col("finding").isNotNull())
        .select("doc_id", "act", "ref", "finding")
    )
    spans = drafts.select("doc_id", "act", F.explode(ranges_of(F.col("text"))).alias("r")).select("doc_id", "act", "r.low", "r.high")
    spans = stage(spans.distinct(), "draft-ranges")
    inside = join_hot(spans, range_findings(spans, live), ["act", "low", "high"], "doc_id")
    return single.unionByName(inside.select("doc_id", "act", "ref", "finding")).distinct()
