"""Coverage, bounded rounds and answer context (G-01 .. G-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.relational import small_side, stage, top_k
from codicil.functions.text import tokens
from codicil.operators.retrieval import KEEP, bm25, rerank
from codicil.operators.understanding import wrap_untrusted
from codicil.schemas import ANSWER, RESPONSE_KEYS

MAX_ROUNDS, MAX_EXCERPTS, MAX_WRITES = 3, 12, 2


def threshold_of(thresholds: dict[str, float] | None, default: float = 0.5) -> Column:
    places = [F.when(F.col("jurisdiction") == j, F.lit(float(t))) for j, t in (thresholds or {}).items()]
    return F.coalesce(*places, F.lit(float(default)))


def coverage(
    queries: DataFrame, excerpts: DataFrame, thresholds: dict[str, float] | None = None, default: float = 0.5
) -> DataFrame:
    """G-01. On point if an excerpt's rerank score reaches the jurisdiction's threshold.

    A question without excerpts is not covered.
    """
    best = excerpts.groupBy("query_id").agg(F.max("score").alias("best"), F.count("*").alias("excerpts"))
    t = threshold_of(thresholds, default)
    return (
        queries.select("query_id", "jurisdiction")
        .join(best, "query_id", "left")
        .withColumns(
            {
                "excerpts": F.coalesce("excerpts", F.lit(0)).cast("bigint"),
                "threshold": t,
                "covered": F.coalesce(F.col("best") >= t, F.lit(False)),
            }
        )
    )


def missing_parts(parts: DataFrame, excerpts: DataFrame, share: float = 0.5) -> DataFrame:
    """G-02. Parts no excerpt supports, with the terms found nowhere.

    ``parts`` (query_id, part_no, text); ``excerpts`` (query_id, text), at most
    twelve per query, so a part's group is bounded.
    """
    asked = parts.select("query_id", "part_no", F.array_distinct(tokens("text")).alias("terms")).where(F.size("terms") > 0)
    held = excerpts.select("query_id", tokens("text").alias("held"))
    met = F.array_intersect("terms", F.coalesce("held", F.array().cast("array<string>")))
    seen = (
        asked.join(held, "query_id", "left")
        .select("query_id", "part_no", "terms", met.alias("met"))
        .groupBy("query_id", "part_no", "terms")
        .agg(
            F.round(F.max(F.size("met") / F.size("terms")), 6).alias("support"),
            F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"),
        )
    )
    return seen.where(F.col("support") < share).select(
        "query_id", "part_no", "support", F.array_sort(F.array_except("terms", "met")).alias("missing_terms")
    )


def retrieve_rounds(
    queries: DataFrame,
    chunks: DataFrame,
    thresholds: dict[str, float] | None = None,
    max_rounds: int = MAX_ROUNDS,
    keep: int = KEEP,
) -> DataFrame:
    """G-03. Up to three rounds; only questions still uncovered go on, refined.

    A refined question keeps the terms its best excerpt lacks. The driver loops
    over rounds and looks at no rows; each round's small result is staged in the
    shared folder. Returns one row per question and round.
    """
    if not 1 <= max_rounds <= MAX_ROUNDS:
        raise ValueError("max_rounds must be within 1..3")
    open_q, log = queries.select("query_id", "jurisdiction", "text"), None
    for no in range(1, max_rounds + 1):
        found = stage(rerank(stage(bm25(chunks, open_q), f"round{no}"), chunks, open_q, keep=keep), f"found{no}")
        state = stage(coverage(open_q, found, thresholds), f"state{no}")
        row = state.select("query_id", "jurisdiction", F.lit(no).alias("round"), "best", "excerpts", "covered")
        log = row if log is None else log.unionByName(row)
        if no == max_rounds:
            break
        top = found.where(F.col("excerpt_no") == 1).select("query_id", "chunk_id")
        seen = chunks.select("chunk_id", tokens("text").alias("held")).join(small_side(top), "chunk_id").drop("chunk_id")
        left = F.array_except(tokens("text"), F.coalesce("held", F.array().cast("array<string>")))
        open_q = stage(
            open_q.join(state.where(~F.col("covered")).select("query_id"), "query_id", "left_semi")
            .join(seen, "query_id", "left")
            .withColumn("left", left)
            .select(
                "query_id",
                "jurisdiction",
                F.when(F.size("left") > 0, F.array_join("left", " ")).otherwise(F.col("text")).alias("text"),
            ),
            f"open{no}",
        )
    return log


def merge_parts(parts: DataFrame) -> DataFrame:
    """G-04. Evidence of all parts of a question, each chunk under its best part.

    Input (query_id, part_no, chunk_id, score, rank) with ranks bounded per part.
    """
    owner = parts.groupBy("query_id", "chunk_id").agg(
        F.max(F.struct("score", (-F.col("part_no")).alias("p"))).alias("top")
    ).select("query_id", "chunk_id", F.col("top.score").alias("score"), (-F.col("top.p")).alias("part_no"))
    cites = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id")))
    per_part = owner.groupBy("query_id", "part_no").agg(F.transform(cites, lambda c: c["chunk_id"]).alias("chunks"))
    return per_part.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("part_no", "chunks"))).alias("parts"), F.sum(F.size("chunks")).alias("cites")
    )


def budget_check(traces: DataFrame) -> DataFrame:
    """G-05. Requests over a budget: rounds, excerpts or writer calls."""
    over = {"rounds": MAX_ROUNDS, "excerpts": MAX_EXCERPTS, "writer_calls": MAX_WRITES}
    names = F.array_compact(F.array(*[F.when(F.col(c) > m, F.lit(c)) for c, m in over.items()]))
    return traces.withColumn("violations", names).where(F.size("violations") > 0)


def step_log(rounds: DataFrame) -> DataFrame:
    """G-06. One log line per round, gathered per question (three rounds at most)."""
    line = F.concat(
        F.lit("round "), F.col("round"), F.lit(": searched "), F.col("n_variants"), F.lit(" variants, found basis for "),
        F.col("found"), F.lit(", still missing "), F.col("missing"),
    )
    return rounds.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("round", line.alias("line")))), lambda r: r["line"]).alias("steps")
    )


def compare_modes(single: DataFrame, looped: DataFrame) -> DataFrame:
    """G-07. Coverage gain against added latency per tag, over (query_id, tag, covered, ms)."""
    a = single.select("query_id", "tag", F.col("covered").cast("int").alias("a"), F.col("ms").alias("a_ms"))
    b = looped.select("query_id", F.col("covered").cast("int").alias("b"), F.col("ms").alias("b_ms"))
    return a.join(b, "query_id").groupBy("tag").agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.col("b") - F.col("a")), 6).alias("coverage_gain"),
        F.round(F.avg(F.col("b_ms") - F.col("a_ms")), 6).alias("added_ms"),
    )


def answer_context(excerpts: DataFrame, max_excerpts: int = MAX_EXCERPTS) -> DataFrame:
    """G-08. Writer input per question: at most ``max_excerpts`` numbered, wrapped excerpts."""
    kept = top_k(excerpts, ["query_id"], [F.col("excerpt_no").asc()], max_excerpts, "__n").drop("__n")
    piece = F.concat(F.lit("["), F.col("excerpt_no"), F.lit("] "), wrap_untrusted("text"))
    return kept.groupBy("query_id").agg(
        F.count("*").alias("excerpts"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("excerpt_no", piece.alias("p")))), lambda s: s["p"]), "\n"
        ).alias("context"),
    )


def parse_answer(df: DataFrame, column: str = "payload") -> DataFrame:
    """G-09. Parse writer JSON; a usable answer has a direct answer or owns to lacking context."""
    kept = [c for c in df.columns if c != column]
    a = F.col("a")
    return df.withColumn("a", F.from_json(column, ANSWER)).select(
        *kept,
        a["direct_answer"].alias("direct_answer"),
        F.coalesce(a["insufficient_context"], F.lit(False)).alias("insufficient_context"),
        F.coalesce(
            a["insufficient_context"] | (F.length(a["direct_answer"]) > 0), F.lit(False)
        ).alias("usable"),
    )


def check_contract(df: DataFrame, column: str = "payload") -> DataFrame:
    """G-09. Required response keys that a JSON object lacks; all of them if it does not parse."""
    kept = [c for c in df.columns if c != column]
    wanted = F.array(*[F.lit(k) for k in RESPONSE_KEYS])
    have = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    return df.select(*kept, F.array_sort(F.array_except(wanted, have)).alias("missing_keys")).withColumn(
        "valid", F.size("missing_keys") == 0
    )


