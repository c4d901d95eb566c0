"""Query understanding and jurisdiction honesty (Q-01 .. Q-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.relational import drop_staged, flags_to_reasons, small_side, stage, staged_paths
from codicil.functions.text import shingles, squash, tokens
from codicil.schemas import PLACE, UNDERSTANDING

# Question types in rule order, each with its pattern.
QUESTION_RULES = [
    ("definition", r"(^|[^\p{L}])(what is|what does|means|defined|definition of|was ist|qu'est)([^\p{L}]|$)"),
    ("penalty", r"(^|[^\p{L}])(penalty|fine|offence|imprisonment|strafe|amende)([^\p{L}]|$)"),
    ("procedure", r"(^|[^\p{L}])(how do|how to|procedure|apply|file|notice period|verfahren)([^\p{L}]|$)"),
    ("obligation", r"(^|[^\p{L}])(must|shall|required|may i|can i|obligation|muss|doit)([^\p{L}]|$)"),
]
QUESTION_TYPES = ("definition", "penalty", "procedure", "obligation", "general")
INTENTS = ("ask", "draft", "review", "improve")

# Instruction patterns refused in client text.
INJECTION = {
    "ignore_instructions": r"ignore (all |any )?(previous|prior|above) (instructions|rules)",
    "reveal_prompt": r"(reveal|print|show) (the |your )?(system )?prompt",
    "role_override": r"(^|[^\p{L}])(you are now|act as|pretend to be)([^\p{L}]|$)",
    "role_tag": r"<\s*/?\s*(system|assistant|developer)\s*>",
    "skip_citations": r"(without|skip|omit) (any )?(citations|sources|verification)",
}


def parse_understanding(df: DataFrame, column: str = "payload") -> DataFrame:
    """Q-01. Parse understanding JSON and list its contract errors; an empty list is valid.

    A jurisdiction is one of the corpus, or a state of the United States (``us-ca``).
    """
    parsed = F.from_json(column, f"{UNDERSTANDING}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    u = F.col("u")
    n = F.size(u["expanded_queries"])
    ok = u["_broken"].isNull()
    flags = {
        "malformed": ~ok,
        "jurisdiction": ok & ~F.coalesce(u["jurisdiction"].rlike(PLACE), F.lit(False)),
        "question_type": ok & ~F.coalesce(u["question_type"].isin(*QUESTION_TYPES), F.lit(False)),
        "expanded_queries": ok & ~F.coalesce(n.between(3, 5), F.lit(False)),
        "named_acts": ok & u["named_acts"].isNull(),
        "intent": ok & ~F.coalesce(u["intent"].isin(*INTENTS), F.lit(False)),
    }
    kept = [c for c in df.columns if c != column]
    return df.withColumn("u", parsed).select(
        *kept,
        F.when(ok, u["jurisdiction"]).alias("jurisdiction"),
        F.when(ok, u["question_type"]).alias("question_type"),
        F.when(ok, u["expanded_queries"]).alias("expanded_queries"),
        F.when(ok, u["named_acts"]).alias("named_acts"),
        F.when(ok, u["intent"]).alias("intent"),
        flags_to_reasons(flags).alias("errors"),
    )


def classify_question(df: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Q-02. First rule that matches names the question type, else ``general``."""
    low = F.lower("text")
    hits = [F.when(low.rlike(pattern), F.lit(name)) for name, pattern in rules or QUESTION_RULES]
    return df.withColumn("question_type", F.coalesce(*hits, F.lit("general")))


def phrase_matches(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Aliases of the dictionary in each question, cut leftmost and longest first, with their expansions.

    Rows: query_id, jurisdiction, toks and ``matches``, an array of (start, size,
    alias, expansions). Aliases and questions are compared as runs of lower-cased
    words. The runs of a question, up to the longest alias, meet the dictionary in
    an equi-join, so neither side is held whole by a task; a question's own matches
    are then folded in one pass.
    """
    known = (
        synonyms.select("jurisdiction", F.array_join(tokens("alias"), " ").alias("alias"), F.explode("expansions").alias("x"))
        .where("alias <> '' AND x IS NOT NULL")
        .groupBy("jurisdiction", "alias")
        .agg(F.array_sort(F.collect_set("x")).alias("expansions"))
    )
    longest = known.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    base = queries.select("query_id", "jurisdiction", tokens("text").alias("toks"))
    toks = F.col("toks")

    def runs(width: int) -> Column:
        return F.transform(shingles(toks, width), lambda run, i: F.struct(run.alias("alias"), i.alias("start"), F.lit(width).alias("size")))

    every = [runs(w) for w in range(1, longest + 1)]
    found = (
        base.select("query_id", "jurisdiction", F.inline_outer(F.flatten(F.array(*every))))
        .join(small_side(known), ["jurisdiction", "alias"])
        .groupBy("query_id", "jurisdiction")
        .agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("size")).alias("order"), "size", "alias", "expansions"))).alias("all"))
    )
    kept = "aggregate(all, filter(all, m -> false), (kept, m) -> IF(size(kept) > 0 AND m.start < kept[size(kept) - 1].start + kept[size(kept) - 1].size, kept, concat(kept, array(m))))"
    return base.join(found.select("query_id", "jurisdiction", F.expr(kept).alias("matches")), ["query_id", "jurisdiction"])


def expand_queries(queries: DataFrame, synonyms: DataFrame, max_n: int = 5) -> DataFrame:
    """Q-03. Variant 0 is the question; up to ``max_n - 1`` more replace an alias by an expansion.

    ``synonyms`` is (jurisdiction, alias, expansions); an alias may be of several
    words and of any case. A question is cut into its longest aliases first, so an
    alias inside a longer one that matches is not replaced.
    """
    met = phrase_matches(queries, synonyms)
    chosen = F.explode(F.array_distinct(F.flatten(F.transform("matches", lambda m: F.transform(m["expansions"], lambda x: F.struct(m["alias"].alias("alias"), x.alias("x")))))))
    met = met.withColumn("swap", chosen)
    spots = F.col("spots")
    begins = lambda i: F.exists(spots, lambda m: m["start"] == i)
    covered = lambda i: F.exists(spots, lambda m: (m["start"] < i) & (i < m["start"] + m["size"]))
    swapped = F.transform(
        "toks", lambda t, i: F.when(begins(i), F.col("swap.x")).when(~covered(i), t)
    )
    met = met.withColumn("spots", F.filter("matches", lambda m: m["alias"] == F.col("swap.alias")))
    extra = (
        met.select("query_id", "jurisdiction", F.array_join(swapped, " ").alias("text"))
        .groupBy("query_id", "jurisdiction")
        .agg(F.slice(F.array_sort(F.collect_set("text")), 1, max_n - 1).alias("v"))
        .select("query_id", "jurisdiction", F.posexplode("v").alias("variant_no", "text"))
        .withColumn("variant_no", F.col("variant_no") + 1)
    )
    first = queries.select("query_id", "jurisdiction", "text").withColumn("variant_no", F.lit(0))
    return first.unionByName(extra)


ACT_NUMBER = r"\b(?i:act)(?: (?i:no|number)\.?)? ?([0-9]+ of [0-9]{4})"


def named_acts(queries: DataFrame, acts: DataFrame) -> DataFrame:
    """Q-04. Acts a question names, by number or by alias.

    ``acts`` is (alias, act); an alias may be a number (``Act 71 of 2008``). The
    question's word runs, up to the longest alias, meet the aliases in an
    equi-join, so no alias is tried against every question. A number that no alias
    resolves stays as an Act of its own.
    """
    known = acts.select(F.array_join(tokens("alias"), " ").alias("alias"), "act").distinct()
    max_words = known.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    numbers = queries.select(
        "query_id", F.explode_outer(F.regexp_extract_all("text", F.lit(ACT_NUMBER), F.lit(1))).alias("number")
    ).where(F.col("number").isNotNull())
    numbers = numbers.select("query_id", F.concat(F.lit("act "), F.lower("number")).alias("alias"), "number")
    by_number = numbers.join(small_side(known), "alias", "left").select(
        "query_id", F.coalesce("act", F.concat(F.lit("Act "), F.col("number"))).alias("act")
    )
    runs = queries.select("query_id", tokens("text").alias("toks")).withColumn(
        "alias",
        F.explode_outer(F.array_distinct(F.flatten(F.array(*[shingles(F.col("toks"), w) for w in range(1, max_words + 1)])))),
    )
    by_alias = runs.join(small_side(known), "alias").select("query_id", "act")
    return by_number.unionByName(by_alias).distinct()


def jurisdiction_gate(named: DataFrame, acts: DataFrame) -> DataFrame:
    """Q-05. Mismatch if no named Act is held where the user looks; suggest who holds most.

    ``named`` is (query_id, picked, act); ``acts`` is (act, jurisdiction). Acts
    nobody holds say nothing about the jurisdiction (Q-06 refuses them).
    """
    holders = acts.select("act", F.col("jurisdiction").alias("held_in")).distinct()
    votes = (
        named.join(small_side(holders), "act")
        .groupBy("query_id", "picked", "held_in")
        .agg(F.countDistinct("act").alias("n"))
    )
    judged = votes.groupBy("query_id", "picked").agg(
        (~F.bool_or(F.col("held_in") == F.col("picked"))).alias("mismatch"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("held_in").alias("j")))["j"].alias("top"),
    )
    return judged.select(
        "query_id", "picked", "mismatch", F.when(F.col("mismatch"), F.col("top")).alias("suggested_jurisdiction")
    )


def act_held_gate(named: DataFrame, held: DataFrame) -> DataFrame:
    """Q-06. Named Acts the picked jurisdiction does not hold; the question is refused by name."""
    have = held.select(F.col("jurisdiction").alias("picked"), "act").distinct()
    return named.join(small_side(have), ["picked", "act"], "left_anti").select("query_id", "picked", "act")


# --- cache ----------------------------------------------------------------

def cache_key(jurisdiction: str = "jurisdiction", text: str = "text") -> Column:
    """Q-07. Key of a question: its jurisdiction and normalized text."""
    return F.sha2(F.concat_ws("#", jurisdiction, squash(F.lower(text))), 256)


#: Parts of a lifetime in which requests are looked up; more parts mean smaller groups and more of them.
CELLS = 4096


def next_requests(times: DataFrame, after: int) -> DataFrame:
    """First request of the same key at or after ``us + after``, for each (key, us): column ``next``, null if none.

    Time is cut in cells. The answer lies in the cell of the time asked for, where
    requests and questions meet in one small group, or is the first request of a
    later cell; the first requests of a key's cells are as many as its cells in use,
    not its requests. Both windows look back from the end, so each is one running
    minimum; a frame up to the end is computed anew for every row.
    """
    width = max(1, after // CELLS)
    cell = lambda c: F.floor(F.col(c) / width)
    events = times.select("key", "us").withColumn("cell", cell("us"))
    asked = times.select("key", "us", (F.col("us") + after).alias("t")).withColumn("cell", cell("t"))
    ahead = Window.partitionBy("key", "cell").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    both = events.select("key", "cell", F.col("us").alias("t"), F.lit(None).cast("bigint").alias("us"), F.lit(1).alias("kind")).unionByName(
        asked.select("key", "cell", "t", "us", F.lit(0).alias("kind"))
    )
    here = both.withColumn("here", F.min(F.when(F.col("kind") == 1, F.col("t"))).over(ahead)).where("kind = 0")
    firsts = events.groupBy("key", "cell").agg(F.min("us").alias("first"))
    marks = firsts.unionByName(asked.select("key", "cell", F.lit(None).cast("bigint").alias("first"))).groupBy("key", "cell").agg(
        F.min("first").alias("first")
    )
    beyond = Window.partitionBy("key").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    later = marks.select("key", "cell", F.min("first").over(beyond).alias("later"))
    return here.join(later, ["key", "cell"]).select("key", "us", F.coalesce("here", "later").alias("next"))


def cache_hits(requests: DataFrame, ttl_hours: int = 24) -> DataFrame:
    """Q-07. Requests and misses per (key, ts); a miss stores an entry that lives ``ttl_hours``.

    The lifetime runs from the store, so stores form a chain per key: from the first
    request to the first at or after its end, and so on. The chain is walked by
    pointer doubling: each round joins the pointers with themselves, so a chain
    of n stores takes log2 n rounds, whatever the length of the log, and rows are
    spread by (key, time), so a question that holds a third of the log is never
    gathered anywhere. Every other request is a hit.
    """
    per = stage(
        requests.groupBy("key", "jurisdiction", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).agg(
            F.count("*").alias("requests")
        ),
        "requests",
    )
    spark, times = per.sparkSession, per.select("key", "us").distinct()
    with staged_paths() as old:
        jumps = stage(next_requests(times, ttl_hours * 3_600_000_000).where("next IS NOT NULL"), "jumps")
        stores = stage(times.groupBy("key").agg(F.min("us").alias("us")), "stores")
    while True:
        with staged_paths() as new:
            reached = stage(stores.join(jumps, ["key", "us"]).select("key", F.col("next").alias("us")), "reached")
            if reached.isEmpty():
                break
            stores = stage(stores.unionByName(reached), "stores")
            onward = jumps.select("key", F.col("us").alias("next"), F.col("next").alias("last"))
            jumps = stage(jumps.join(onward, ["key", "next"]).select("key", "us", F.col("last").alias("next")), "jumps")
        drop_staged(spark, old)
        old = new
    return per.join(stores.withColumn("stored", F.lit(1)), ["key", "us"], "left").select(
        "key", "jurisdiction", "us", "requests", F.coalesce("stored", F.lit(0)).cast("bigint").alias("misses")
    )


def hit_rate(hits: DataFrame) -> DataFrame:
    """Q-08. Hit rate per jurisdiction."""
    total, missed = F.sum("requests"), F.sum("misses")
    return hits.groupBy("jurisdiction").agg(
        total.alias("requests"), (total - missed).alias("hits"), F.round((total - missed) / total, 6).alias("hit_rate")
    )


# --- parts, screening, caps -----------------------------------------------

# Words that open a clause of a compound question.
OPENERS = (
    "who|what|when|where|which|why|how|whether|is|are|was|were|can|could|must|may|should|does|do|did|will|would|has|have|if|"
    "wer|was|wann|wo|wie|warum|welche|welcher|welches|ob|ist|sind|kann|muss|darf|"
    "qui|que|quand|où|comment|pourquoi|quel|quelle|est|sont|peut|doit|"
    "quién|qué|cuándo|dónde|cómo|cuál|es|son|puede|debe"
)
CLAUSE = rf"(?i),? (?:and|und|et|y) ((?:{OPENERS})[^\p{{L}}\p{{N}}])"


def decompose(queries: DataFrame) -> DataFrame:
    """Q-09. One row per part of a compound question: cut at ? ; line ends, and before a joined clause.

    A joining word cuts only where a clause opens behind it (``and who pays``);
    ``health and safety duties`` stays whole.
    """
    cut = F.split(F.regexp_replace(F.regexp_replace("text", CLAUSE, "\n$1"), r"[?;\n]+", "\n"), "\n")
    parts = F.filter(F.transform(cut, lambda p: squash(p)), lambda p: p != "")
    return queries.select("query_id", F.posexplode_outer(parts).alias("part_no", "text")).where(
        F.col("text").isNotNull()
    )


def screen_injection(df: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Q-10. Names of the instruction patterns found, rejection flag and wrapped text."""
    low = F.lower("text")
    found = flags_to_reasons({n: low.rlike(p) for n, p in (patterns or INJECTION).items()})
    return df.withColumns({"found": found, "wrapped": wrap_untrusted("text")}).withColumn(
        "rejected", F.size("found") > 0
    )


def wrap_untrusted(text: str | Column) -> Column:
    """Client or excerpt text between untrusted marks; marks inside it are defused."""
    text = F.col(text) if isinstance(text, str) else text
    inner = F.regexp_replace(text, r"(?i)</?untrusted>", "")
    return F.concat(F.lit("<untrusted>"), inner, F.lit("</untrusted>"))


def apply_caps(df: DataFrame, caps: dict[str, tuple[int, int]]) -> DataFrame:
    """Q-11. Cap expansions and grant tokens per role; flags what was over.

    ``df`` is (role, expansions, tokens, ...); a role without caps is unbounded.
    """
    def cap(i: int) -> Column:
        return F.coalesce(*[F.when(F.col("role") == r, F.lit(c[i])) for r, c in caps.items()], F.lit(2**31 - 1))

    return df.withColumns(
        {
            "kept": F.slice("expansions", F.lit(1), cap(0)),
            "granted_tokens": F.least("tokens", cap(1)),
            "over_cap": (F.size("expansions") > cap(0)) | (F.col("tokens") > cap(1)),
        }
    )
