"""Ingestion transforms (I-01 .. I-10, I-14, I-15).

Documents are one row each, so sections, chunks and paragraphs are cut with
array expressions inside the row: these steps are maps and move no data.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.relational import small_side
from codicil.functions.text import lines_of, squash, tokens, with_trigrams

# Mark-up removed with its content, and block ends that become line breaks.
DROPPED = ("script", "style", "nav", "footer", "head")
BREAKS = r"(?i)<br\s*/?>|</p>|</h[1-6]>|</li>|</div>|</tr>"
# HTML reads the character numbers 128 to 159 as this code page, and a blank for a no-break space.
WINDOWS = "€\u0081‚ƒ„…†‡ˆ‰Š‹Œ\u008dŽ\u008f\u0090‘’“”•–—˜™š›œ\u009džŸ"
NUMBERED_FROM = "".join(map(chr, range(128, 161)))
NUMBERED_TO = WINDOWS + " "
NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
ENTITY = r"&(?=(?:#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,7}|[A-Za-z][A-Za-z0-9]{1,7});)"

Rules = dict[str, list[tuple[str, str]]]


def decode_entities(text: Column) -> Column:
    """Character references by name, number and hex number, each decoded once, in one pass over the text.

    Numbers that are no character give U+FFFD; unknown names stay as written.
    """
    names = F.create_map(*[F.lit(x) for pair in sorted(NAMED.items()) for x in pair])

    def decoded(part: Column) -> Column:
        name = F.substring_index(part, ";", 1)
        hexed = F.lower(F.substr(name, F.lit(1), F.lit(2))) == "#x"
        digits = F.when(hexed, F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2)))
        code = F.when(name.startswith("#"), digits.cast("bigint"))
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        code = F.when(valid, code).otherwise(F.lit(0xFFFD))
        char = F.translate(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), NUMBERED_FROM, NUMBERED_TO)
        known = F.when(name.startswith("#"), char).otherwise(F.try_element_at(names, name))
        rest = F.substr(part, F.length(name) + 2)
        return F.coalesce(F.concat(known, rest), F.concat(F.lit("&"), part))

    parts = F.split(text, ENTITY)
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(0))), decoded), ""))
    return F.when(text.contains("&"), whole).otherwise(text)


def clean_html(html: Column) -> Column:
    """Text of a page: dropped blocks, tags and comments out, entities decoded, blank lines folded."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in DROPPED:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), r"<[^>]+>", "")
    text = decode_entities(text)
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\s*\n\s*", "\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_html(df: DataFrame, rules: Rules | None = None, column: str = "html") -> DataFrame:
    """I-01. Add ``text``: cleaned mark-up, then the jurisdiction's own replacements."""
    df = df.withColumn("text", clean_html(F.col(column)))
    for place, steps in (rules or {}).items():
        for pattern, with_text in steps:
            df = df.withColumn(
                "text",
                F.when(F.col("jurisdiction") == place, F.regexp_replace("text", pattern, with_text)).otherwise(
                    F.col("text")
                ),
            )
    return df


# --- section tree ---------------------------------------------------------

# Headers per jurisdiction ("*" is the default), outermost first,
# each with the number in a group. Divisions stand above the section, parts below.
Levels = list[tuple[str, str]]
_PART = ("part", r"^(?i:part) ([0-9]+[A-Z]?|[IVXLC]+|[A-Z])\b")
_CHAPTER = ("chapter", r"^(?i:chapter) ([0-9]+[A-Z]?|[IVXLC]+)\b")
_HEADED = r"(?:Section|Sec\.|Article|Art\.|s) ([0-9]+[A-Z]{0,2})\b"
_NUMBERED = r"([0-9]+[A-Z]{0,2})\.? (?=\p{Lu})"
_DIGIT, _LETTER, _ROMAN, _CAPITAL = (
    r"^\(([0-9]+[A-Za-z]{0,2})\)", r"^\(([a-z]{1,2})\)", r"^\(([ivx]+)\)", r"^\(([A-Z]{1,2})\)"
)
DIVISIONS: dict[str, Levels] = {
    "*": [_PART, _CHAPTER],
    "za": [_CHAPTER, _PART],
    "de": [("book", r"^(?i:buch) ([0-9]+)\b"), ("division", r"^(?i:abschnitt) ([0-9]+)\b"), ("title", r"^(?i:titel) ([0-9]+)\b")],
}
SECTION = {
    "*": rf"^(?:{_HEADED}|{_NUMBERED})",
    "us": rf"^(?:{_HEADED}|§ ?([0-9]+[A-Za-z]?)\b|{_NUMBERED})",
    "de": r"^(?:§|Artikel|Art\.) ?([0-9]+[a-z]?)\b",
}
PARTS: dict[str, Levels] = {
    "*": [("subsection", _DIGIT), ("paragraph", _LETTER), ("subparagraph", _ROMAN), ("item", _CAPITAL)],
    "us": [("subsection", _LETTER), ("paragraph", _DIGIT), ("subparagraph", _CAPITAL), ("clause", _ROMAN)],
    "de": [("subsection", r"^\(([0-9]+[a-z]?)\)"), ("number", r"^([0-9]+[a-z]?)\. "), ("letter", r"^([a-z])\) "), ("double_letter", r"^([a-z]{2})\) ")],
}
# Roman numbers that are letters as well, with the letters around them and the Roman number that follows.
BOTH_WAYS = {"i": ("h", "j", "ii"), "v": ("u", "w", "vi"), "x": ("w", "y", "xi")}
PROVISO = r"^(Provided that|Provided, however|Except that)\b"
DEFINITION = r'"([^"]+)" (?:means|bedeutet|includes)\b'


def levels_of(place: str) -> tuple[Levels, int]:
    """All levels of a jurisdiction, outermost first, and the place of its section."""
    above = DIVISIONS.get(place, DIVISIONS["*"])
    below = PARTS.get(place, PARTS["*"])
    return [*above, ("section", SECTION.get(place, SECTION["*"])), *below], len(above)


def _slots() -> tuple[int, int]:
    """Division slots and slots in all, so that the sections of all jurisdictions share one slot."""
    above = max(len(v) for v in DIVISIONS.values())
    return above, above + 1 + max(len(v) for v in PARTS.values())


def _mark(line: Column, place: str) -> Column:
    """(slot, kind, no) of a header line, null for any other; the outermost level that matches counts."""
    levels, section = levels_of(place)
    shift = _slots()[0] - section
    found = F.lit(None).cast("struct<slot:int,kind:string,no:string>")
    for k, (kind, pattern) in reversed(list(enumerate(levels))):
        groups = range(1, re.compile(pattern.replace(r"\p{Lu}", "[A-Z]")).groups + 1)
        no = F.coalesce(*[F.nullif(F.regexp_extract(line, pattern, g), F.lit("")) for g in groups])
        found = F.when(line.rlike(pattern), F.struct(F.lit(k + shift).alias("slot"), F.lit(kind).alias("kind"), no.alias("no"))).otherwise(found)
    return found


def _roman_or_letter(place: str, mark: Column, before: Column, after: Column) -> Column:
    """A mark such as ``(i)`` read by its neighbours: after ``(h)`` or before ``(j)`` it is a letter, else a number."""
    levels, section = levels_of(place)
    slot_of = {pattern: (k + _slots()[0] - section, kind) for k, (kind, pattern) in enumerate(levels)}
    if _LETTER not in slot_of or _ROMAN not in slot_of:
        return mark
    is_letter = F.lit(False)
    for no, (left, right, roman) in BOTH_WAYS.items():
        fits = ((before["no"] == left) & ~F.coalesce(after["no"] == roman, F.lit(False))) | (after["no"] == right)
        is_letter = F.when(mark["no"] == no, F.coalesce(fits, F.lit(False))).otherwise(is_letter)
    as_ = lambda pattern: F.struct(
        F.lit(slot_of[pattern][0]).alias("slot"), F.lit(slot_of[pattern][1]).alias("kind"), mark["no"].alias("no")
    )
    lettered = mark["no"].rlike("^[ivx]+$") & mark["slot"].isin(slot_of[_LETTER][0], slot_of[_ROMAN][0])
    return F.when(lettered, F.when(is_letter, as_(_LETTER)).otherwise(as_(_ROMAN))).otherwise(mark)


def _by_place(use: Callable[[str], Column]) -> Column:
    """The expression of the row's jurisdiction, else the default one."""
    chosen = use("*")
    for place in sorted({*DIVISIONS, *SECTION, *PARTS} - {"*"}):
        chosen = F.when(F.col("jurisdiction") == place, use(place)).otherwise(chosen)
    return chosen


def _nodes(docs: DataFrame, key: str) -> DataFrame:
    """Documents with ``__nodes``: one (pos, slot, kind, no, lines) per header, and one for text before the first."""
    lines, marks, heads = F.col("__lines"), F.col("__marks"), F.col("__heads")
    found = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("pos"), _by_place(lambda p: _mark(line, p)).alias("mark"))),
        lambda x: (x["pos"] == 0) | x["mark"].isNotNull(),
    )
    read = F.transform(
        marks,
        lambda x, k: F.struct(
            x["pos"].alias("pos"),
            _by_place(
                lambda p: _roman_or_letter(p, x["mark"], F.get(marks, k - 1)["mark"], F.get(marks, k + 1)["mark"])
            ).alias("mark"),
        ),
    )
    node = F.transform(
        heads,
        lambda x, k: F.struct(
            x["pos"].alias("pos"), x["mark"]["slot"].alias("slot"), x["mark"]["kind"].alias("kind"), x["mark"]["no"].alias("no"),
            F.slice(lines, x["pos"] + 1, F.coalesce(F.get(heads, k + 1)["pos"], F.size(lines)) - x["pos"]).alias("lines"),
        ),
    )
    base = docs.select(key, "jurisdiction", "act", lines_of("text").alias("__lines"))
    base = base.withColumn("__marks", found).withColumn("__heads", read).withColumn("__nodes", node)
    return base.drop("__lines", "__marks", "__heads")


def _cut(df: DataFrame, slot: int) -> DataFrame:
    """One row per run of nodes that a header of this slot begins, with its number and title; deeper runs stay inside."""
    nodes, at = F.col("__nodes"), F.col("__at")
    starts = F.filter(
        F.sequence(F.lit(0), F.size(nodes) - 1), lambda i: (i == 0) | F.coalesce(F.get(nodes, i)["slot"] == slot, F.lit(False))
    )
    runs = F.transform(at, lambda s, k: F.slice(nodes, s + 1, F.coalesce(F.get(at, k + 1), F.size(nodes)) - s))
    df = df.withColumn("__at", starts).withColumn("__runs", runs).drop("__at", "__nodes")
    df = df.withColumn("__nodes", F.explode_outer("__runs")).drop("__runs")
    head = F.get("__nodes", F.lit(0))
    return df.withColumn(f"__s{slot}", F.when(head["slot"] == slot, F.struct(head["kind"].alias("kind"), head["no"].alias("no"), F.get(head["lines"], F.lit(0)).alias("line"))))


def detect_sections(docs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """I-02. Statute tree of each document at any depth, top to bottom, heading carried to all below a section.

    Headers follow the rule table of the jurisdiction: divisions (part, chapter,
    book), the section in its forms (``Section 5``, ``145. Review``, ``Article 5``,
    ``§ 5``), then its parts such as ``(1)``, ``(a)``, ``(i)``. A header closes all
    levels below its own, and levels may be skipped. The document is cut level by
    level inside its row, so nothing is shuffled and each level reads a line once.

    Rows: key, jurisdiction, act, division (``["Part 2", "Chapter 1"]``), section_no, sub_no
    (number of a node below its section), section_path, parent_no, level, kind, heading,
    text, first_line. Text before the first section has level 0; a null text gives one row without text.
    """
    above, slots = _slots()
    tree = _nodes(docs, key)
    for slot in range(slots):
        tree = _cut(tree, slot)
    node = F.get("__nodes", F.lit(0))
    tree = tree.withColumn("__node", node).withColumn(
        "section_path", F.array_compact(F.array(*[F.col(f"__s{k}")["no"] for k in range(above, slots)]))
    )
    section, depth, lines = F.col(f"__s{above}"), F.size("section_path"), F.col("__node")["lines"]
    titled = [F.concat(F.initcap(F.replace(F.col(f"__s{k}")["kind"], F.lit("_"), F.lit(" "))), F.lit(" "), F.col(f"__s{k}")["no"]) for k in range(above)]
    kind = (
        F.when(F.exists(lines, lambda x: x.rlike(PROVISO)), "proviso")
        .when(F.exists(lines, lambda x: x.rlike(DEFINITION)), "definition")
        .otherwise(F.coalesce(F.col("__node")["kind"], F.lit("preamble")))
    )
    own = F.coalesce(F.col("__node")["slot"] > above, F.lit(False))
    return tree.select(
        key,
        "jurisdiction",
        "act",
        F.array_compact(F.array(*titled)).alias("division"),
        section["no"].alias("section_no"),
        F.when(own, F.col("__node")["no"]).alias("sub_no"),
        "section_path",
        F.when(own, F.get("section_path", depth - 2)).alias("parent_no"),
        F.when(section.isNull() & (depth > 0), depth + 1).otherwise(depth).alias("level"),
        kind.alias("kind"),
        section["line"].alias("heading"),
        F.array_join(lines, "\n").alias("text"),
        F.col("__node")["pos"].alias("first_line"),
    )


def defined_terms(docs: DataFrame) -> DataFrame:
    """I-03. Distinct defined terms per jurisdiction and Act."""
    return (
        docs.select(
            "jurisdiction",
            "act",
            F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(DEFINITION), F.lit(1)))).alias("term"),
        )
        .where(F.col("term").isNotNull())
        .distinct()
    )


def chunk_sections(docs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """I-04. One chunk per section or subsection, never across sections."""
    return detect_sections(docs, key).withColumn("tokens", F.size(tokens("text"))).withColumn(
        "piece_id", F.concat_ws(":", F.col(key).cast("string"), F.col("first_line").cast("string"))
    )


def parent_context() -> Column:
    return F.concat_ws(
        " | ", "act", F.concat(F.lit("s "), F.array_join("section_path", ".")), F.col("heading")
    )


def with_parent_context(chunks: DataFrame) -> DataFrame:
    """I-05. Put Act, section number and heading before the text.

    The heading already travels with each subsection, so no join is needed.
    """
    return chunks.withColumn("text", F.concat_ws("\n", parent_context(), "text"))


def chunk_cases(pages: DataFrame) -> DataFrame:
    """I-06. One chunk per paragraph, with the case's headnote attached.

    The headnote is the page's first heading; ``text`` is normalized (I-01).
    """
    head = clean_html(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    cut = pages.select("page_id", "jurisdiction", head.alias("headnote"), F.posexplode_outer(lines_of("text")).alias("para_no", "text"))
    return cut.where((F.col("text") != "") & (F.col("text") != F.col("headnote")))


# --- versions -------------------------------------------------------------

def version_diff(prev: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """I-08. Change per key between two snapshots, with its note.

    Texts are hashed before the join, so the shuffle carries keys and digests. Null
    keys are equal to each other, and a null text is a text like any other.
    """
    def digest(df: DataFrame, side: str) -> DataFrame:
        extra = [F.col("effective_from"), F.col("as_at")] if side == "new" else []
        keys = [F.col(k).alias(f"{side}_{k}") for k in key]
        return df.select(*keys, F.coalesce(F.md5(squash("text")), F.lit("")).alias(f"{side}_hash"), *extra)

    same = [F.col(f"prev_{k}").eqNullSafe(F.col(f"new_{k}")) for k in key]
    both = digest(prev, "prev").join(digest(new, "new"), same, "full_outer")
    both = both.withColumns({k: F.coalesce(f"prev_{k}", f"new_{k}") for k in key})
    change = (
        F.when(F.col("prev_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("prev_hash") != F.col("new_hash"), "amended")
        .otherwise("unchanged")
    )
    place = F.concat(F.lit("s "), F.col("section_no"), F.lit(" of "), F.col("act"))
    return both.withColumn("change", change).select(
        *key,
        "change",
        F.when(F.col("change").isin("amended", "removed"), F.concat(F.col("change"), F.lit(": "), place)).alias(
            "amendment_note"
        ),
        F.when(
            F.col("effective_from") > F.col("as_at"),
            F.concat(F.lit("commences on "), F.col("effective_from").cast("string")),
        ).alias("commencement_note"),
    )


SECTION_KEY = ["act", "section_no"]


def close_intervals(versions: DataFrame) -> DataFrame:
    """I-10. Close each version's validity at the next version's start.

    Works on the narrow version table (no texts); a section's group holds one
    row per version.
    """
    w = Window.partitionBy(*SECTION_KEY).orderBy("version")
    return versions.withColumn("effective_to", F.lead("effective_from").over(w))


def in_force_at(d: dt.date | Column) -> Column:
    d = d if isinstance(d, Column) else F.lit(d)
    return (F.col("effective_from") <= d) & (F.col("effective_to").isNull() | (d < F.col("effective_to")))


def stamp(versions: DataFrame, as_at: dt.date) -> DataFrame:
    """I-09. Stamp as-at date and in-force flag on closed versions."""
    return close_intervals(versions).withColumns(
        {"as_at": F.lit(as_at), "in_force": in_force_at(as_at) & (F.col("status") == "in_force")}
    )


def as_of(versions: DataFrame, d: dt.date) -> DataFrame:
    """I-10. The version of each section that is valid on ``d``.

    Predicates reach the scan, a given ``effective_to`` included; then the latest
    started version is kept with a partial aggregate, so a section never gathers.
    """
    facts = [c for c in versions.columns if c not in (*SECTION_KEY, "version", "effective_from")]
    valid = in_force_at(d) if "effective_to" in versions.columns else F.col("effective_from") <= F.lit(d)
    started = versions.where(valid)
    latest = started.groupBy(*SECTION_KEY).agg(
        F.max(F.struct("effective_from", "version", *facts)).alias("v")
    )
    return latest.select(*SECTION_KEY, "v.*")


# --- names and authority --------------------------------------------------

def trigram_match(names: DataFrame, aliases: DataFrame, threshold: float = 0.3) -> DataFrame:
    """I-14. Pairs (name, alias) whose trigram sets have Jaccard similarity >= ``threshold``.

    Copies are folded first. Grams are ordered from rare to frequent and only
    each set's prefix is joined: two sets that similar must share a prefix gram,
    so the result is exact while frequent grams hardly ever meet.
    """
    left = with_trigrams(names.select("name").distinct(), "name")
    right = with_trigrams(aliases.select("alias").distinct(), "alias")

    def grams(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode_outer("grams").alias("gram")).where(F.col("gram").isNotNull())

    freq = (
        grams(left, "name").select("gram").unionAll(grams(right, "alias").select("gram")).groupBy("gram").count()
    )

    def prefix(df: DataFrame, key: str) -> DataFrame:
        ordered = (
            grams(df, key)
            .join(freq, "gram")
            .groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("count", "gram"))).alias("g"))
        )
        n = F.size("g")
        reach = n - F.ceil(n * threshold - 1e-9).cast("int") + 1
        return ordered.select(key, F.explode_outer(F.slice(F.col("g"), F.lit(1), reach)).alias("p")).select(
            key, F.col("p.gram").alias("gram")
        )

    pairs = prefix(left, "name").join(prefix(right, "alias"), "gram").select("name", "alias").distinct()
    scored = with_trigrams(with_trigrams(pairs, "name", "a"), "alias", "b")
    same = F.size(F.array_intersect("a", "b"))
    sim = same / (F.size("a") + F.size("b") - same)
    return scored.where(sim >= threshold).select("name", "alias", F.round(sim, 6).alias("similarity"))


def with_authority(cases: DataFrame, treatment: DataFrame) -> DataFrame:
    """I-15. Attach court, authority level and treatment from a curated table."""
    return cases.join(small_side(treatment), "case_id", "left").withColumns(
        {
            "authority_level": F.coalesce("authority_level", F.lit(0)),
            "treatment": F.coalesce("treatment", F.lit("unknown")),
        }
    )
