"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.llm.words import text_of

#: Kinds in their order of listing. A possessive run that may only start after a character outside
#: its class (or where the last match ended) finds what the plain pattern finds, without quadratic scans. The card pattern takes whole digit chains of
#: 12 to 19 digits, which are the plain pattern's matches of that length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
HINTS = {"email": "@", "phone": "+"}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
#: Lower-case words that raise the score of a span when they stand shortly before it.
CONTEXT = {
    "email": "mail|contact|correo|courriel",
    "ip": r"\bip\b|host|server|address",
    "card": "card|visa|mastercard|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobil|fax",
    "iban": "iban|account|konto|compte|cuenta",
    "ssn": "ssn|social security",
}
_SPAN = "struct<start:int,kind_no:int,stop:int,value:string,score:double>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = _digits(value)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return n.between(12, 19) & (F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0)


def mod97(value: Column) -> Column:
    """15 to 34 characters whose number, letters as 10 to 35, leaves 1 modulo 97."""
    packed = F.regexp_replace(value, r"\x20", "")
    n = F.length(packed)
    turned = F.concat(F.substring(packed, 5, 40), F.substring(packed, 1, 4))

    def add(total: Column, i: Column) -> Column:
        c = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(c >= 65, total * 100 + c - 55).otherwise(total * 10 + c - 48) % 97

    return n.between(15, 34) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) == 1)


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


def _placed(kind: str, found: Column, gaps: Column, text: Column, reach: int) -> Column:
    """Spans of one kind in code points, from its matches and the texts between them."""
    number = list(PATTERNS).index(kind)

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(gaps, i))
        stop = start + F.length(F.get(found, i))
        before = F.lower(text.substr(F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach))))
        score = F.lit(PRIOR[kind]) + F.when(before.rlike(CONTEXT[kind]), 0.2).otherwise(0.0)
        span = F.struct(
            start.alias("start"),
            F.lit(number).alias("kind_no"),
            stop.alias("stop"),
            F.get(found, i).alias("value"),
            F.least(score, F.lit(1.0)).alias("score"),
        )
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    empty = F.array().cast(f"array<{_SPAN}>")
    walked = F.aggregate(
        F.sequence(F.lit(0), F.size(found) - 1),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        step,
        lambda acc: acc["out"],
    )
    return F.when(F.size(found) > 0, F.filter(walked, lambda s: confirmed(kind, s["value"]))).otherwise(empty)


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 40, least_score: float = 0.5
) -> DataFrame:
    """Adds nothing but reads id and text: id, ``text`` and ``found``, the spans of every kind ordered by start.

    Matches are leftmost and non-overlapping per kind over the whole text. A
    checksum or range check drops a match for good. The score is a prior per kind,
    raised if a word of that kind stands within ``reach`` code points before it;
    spans of the added kinds below ``least_score`` are dropped, the base kinds stay.

    A null text counts as empty and has no spans. Equal rows give equal results.
    Everything is a map over rows: no shuffle.
    """
    df = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))
    none = F.array().cast("array<string>")
    may = {k: F.col("text").contains(HINTS[k]) for k in HINTS}
    df = df.withColumn("numeric", F.col("text").rlike("[0-9]"))
    for kind, pattern in PATTERNS.items():
        possible = may.get(kind, F.col("numeric"))
        df = df.withColumn(
            f"{kind}_found",
            F.when(possible, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none),
        )
    for kind, pattern in PATTERNS.items():
        df = df.withColumn(
            f"{kind}_gaps",
            F.when(F.size(f"{kind}_found") > 0, F.split("text", pattern, -1)).otherwise(none),
        )
    for kind in PATTERNS:
        df = df.withColumn(
            f"{kind}_spans",
            _placed(kind, F.col(f"{kind}_found"), F.col(f"{kind}_gaps"), F.col("text"), reach),
        )
    spans = F.array_sort(F.concat(*[F.col(f"{k}_spans") for k in PATTERNS]))
    df = df.withColumn("spans", spans)
    kept = F.filter("spans", lambda s: (s["kind_no"] < len(BASE)) | (s["score"] >= least_score))
    return df.select(F.col("id").alias(id_col), "text", kept.alias("found"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in PATTERNS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with each found value replaced by its kind in angle brackets, outermost span first."""
    found = find_pii(docs, id_col, text_col)
    names = F.array(*[F.lit(f"<{k}>") for k in PATTERNS])

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(
                s["stop"].alias("at"),
                F.concat(
                    acc["out"],
                    F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]),
                    F.get(names, s["kind_no"]),
                ).alias("out"),
            )
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(
        "found",
        start,
        step,
        lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))),
    )
    return found.select(id_col, whole.alias("masked"))


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per base kind, a digest of the base spans, all spans, and the highest score."""
    found = find_pii(docs, id_col, text_col)
    base = F.filter("found", lambda s: s["kind_no"] < len(BASE))
    df = found.select(id_col, "found", base.alias("base"))
    kinds = F.transform("base", lambda s: s["kind_no"])
    counts = [F.size(F.array_remove(kinds, k)) for k in range(len(BASE))]
    counts = [(F.size("base") - n).cast("bigint").alias(f"n_{BASE[k]}") for k, n in enumerate(counts)]
    return df.select(
        id_col,
        *counts,
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
