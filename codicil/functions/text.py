"""Text expressions. All are JVM-side columns; none needs a shuffle.

Where a function takes a token array that a lambda reads, pass a plain column,
not a nested expression: Spark evaluates a lambda's body once per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The plain letters and digits, named first, spare most characters a look at their category.
WORD_BREAK = r"[^a-z0-9\p{L}\p{N}]+"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(col_of(text)), WORD_BREAK), "")


def squash(text: Column | str) -> Column:
    """Collapse white space and trim."""
    return F.trim(F.regexp_replace(col_of(text), r"\s+", " "))


def lines_of(text: Column | str) -> Column:
    return F.split(col_of(text), "\n")


def bigrams(toks: Column) -> Column:
    """Adjacent token pairs joined by one blank; empty below two tokens."""
    n = F.size(toks)
    return F.when(
        n >= 2,
        F.transform(
            F.sequence(F.lit(0), n - 2),
            lambda i: F.concat_ws(" ", F.get(toks, i), F.get(toks, i + 1)),
        ),
    ).otherwise(F.array().cast("array<string>"))


def shingles(toks: Column, width: int) -> Column:
    """Token windows of ``width`` joined by blanks; empty if the text is shorter."""
    n = F.size(toks)
    return F.when(
        n >= width,
        F.transform(
            F.sequence(F.lit(1), n - (width - 1)),
            lambda i: F.array_join(F.slice(toks, i, width), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def with_trigrams(df: DataFrame, name: str, out: str = "grams") -> DataFrame:
    """Distinct character trigrams of the padded, lower-cased name."""
    padded = F.concat(F.lit("  "), squash(F.lower(F.col(name))), F.lit(" "))
    at = F.col("__padded")
    return (
        df.withColumn("__padded", padded)
        .withColumn(
            out,
            F.array_distinct(
                F.transform(F.sequence(F.lit(1), F.length(at) - 2), lambda i: at.substr(i, F.lit(3)))
            ),
        )
        .drop("__padded")
    )


def with_term_counts(df: DataFrame, toks: str = "toks", out: str = "counts") -> DataFrame:
    """Add ``array<struct<term,tf>>`` of a token array, counted inside the row.

    The array is sorted once and cut at the places where the value changes, so
    the cost is n log n per text and no row leaves its task. The steps are
    columns of their own because a lambda re-evaluates any expression it holds.
    """
    run, starts = F.col("__run"), F.col("__starts")
    n = F.size(run)
    return (
        df.withColumn("__run", F.sort_array(F.col(toks)))
        .withColumn(
            "__starts",
            F.filter(
                F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                lambda i: (n > 0) & ((i == 0) | (F.get(run, i) != F.get(run, i - 1))),
            ),
        )
        .withColumn(
            out,
            F.transform(
                starts,
                lambda s, i: F.struct(
                    F.get(run, s).alias("term"),
                    (F.coalesce(F.get(starts, i + 1), n) - s).cast("bigint").alias("tf"),
                ),
            ),
        )
        .drop("__run", "__starts")
    )


def share_in(wanted: Column, held: Column) -> Column:
    """Share of the distinct members of ``wanted`` that are in ``held``; 0 if none wanted."""
    n = F.size(F.array_distinct(wanted))
    return F.when(n > 0, F.size(F.array_intersect(wanted, held)) / n).otherwise(F.lit(0.0))
