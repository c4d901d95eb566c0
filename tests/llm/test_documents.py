"""Operators over documents against brute force, on awkward rows and on the smallest tables."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codicil.llm.bpe import Vocabulary, bpe, bpe_digests, default_path, merged
from codicil.llm.exact_dedup import exact_dedup, keep_one
from codicil.llm.near_dedup import keep_representatives, near_dedup
from codicil.llm.passages import cut_repeats, located
from codicil.llm.pii import find_pii, masked, pii_report
from codicil.llm.quality import PRIOR, quality_rules
from codicil.llm.tokencount import UnigramCounter, pieces_of, token_counts
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.brute import ROWS, frame


def small_rows():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def inputs(spark):
    return [(ROWS, frame(spark)), (small_rows(), spark.read.parquet(f"{SMALL}/documents.parquet")), ([], frame(spark, [(1, "x")]).limit(0))]


# --- op1 ------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def expected_bpe(library, rows):
    out = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(decoded)))
    return sorted(out, key=repr)


def test_bpe_equals_the_library(spark, library):
    for rows, df in inputs(spark):
        got = rows_of(bpe_digests(df), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
        assert got == expected_bpe(library, rows)


def test_bpe_returns_ids_and_texts(spark, library):
    (row,) = bpe(frame(spark, [(1, "Hello hello, World")])).collect()
    assert row.ids == library.encode("Hello hello, World", add_special_tokens=False).ids
    assert row.decoded == library.decode(row.ids, skip_special_tokens=False)


def test_bpe_on_random_strings(library):
    vocab, draw = Vocabulary(default_path()), random.Random(5)
    pool = [*"aAbİßΣςσ'sé̀ ́　 \t\n漢🙂12٣½ǅﬁ\x85\x1c\x00ŉſ×÷", "<|endoftext|>", "<|", "'LL ", "xyz", "##"]
    for _ in range(3000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 30)))
        ids, decoded = vocab.encode(text.encode())
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert decoded.decode() == library.decode(want, skip_special_tokens=False)


def test_merges_take_the_least_rank_and_the_leftmost_pair():
    ranks = {(0, 0): (0, 1), (1, 1): (1, 2), (1, 0): (2, 3)}
    assert merged([0] * 5, ranks) == [2, 0]
    assert merged([0, 0, 0], ranks) == [3]
    assert merged([7], ranks) == [7] and merged([], ranks) == []


# --- op2 ------------------------------------------------------------------

def test_cut_repeats_equals_brute_force(spark):
    for rows, df in inputs(spark):
        for bucket_chars in (6_000_000, 20_000):
            got = rows_of(cut_repeats(df, digests=True, bucket_chars=bucket_chars), "doc_id", "n_words", "n_removed", "kept_sha256")
            assert got == sorted(brute.cut_repeats(rows), key=repr)


def test_cut_repeats_keeps_the_rest_of_the_text(spark):
    got = {r.doc_id: r.kept_text for r in cut_repeats(frame(spark)).collect() if r.doc_id in (8, 9, 10)}
    assert got == {8: "start end of eight", 9: "other words here", 10: "tail"}


def test_windows_meet_across_random_edits(spark):
    draw = random.Random(3)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for d in range(60):
        a, n = draw.randrange(200), draw.randrange(20, 90)
        piece = [w if draw.random() > 0.02 else f"e{draw.random()}" for w in base[a : a + n]]
        rows.append((d, " ".join([f"u{d}", *piece, f"v{d}"] + piece * (d % 3))))
    got = rows_of(cut_repeats(frame(spark, rows), digests=True, bucket_chars=3000), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.cut_repeats(rows), key=repr)


def test_automaton_marks_every_occurrence():
    texts = [np.array([1, 2, 3, 1, 2, 3, 4]), np.array([9, 2, 3])]
    marks = located(texts, {np.array([1, 2, 3]).tobytes(), np.array([2, 3, 4]).tobytes()})
    assert [m.tolist() for m in marks] == [[True] * 7, [False] * 3]


# --- op3 ------------------------------------------------------------------

def test_quality_base_rules(spark):
    for rows, df in inputs(spark):
        trusted = df.select("doc_id").where("doc_id % 2 = 0")
        got = rows_of(
            quality_rules(df, trusted),
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        )
        assert got == sorted(((d, *brute.base_rules(t)) for d, t in rows), key=repr)


@pytest.mark.parametrize("buckets", [64, 1 << 14])
def test_quality_ratio_equals_brute_force(spark, buckets):
    for rows, df in inputs(spark):
        trusted = {d for d, _ in rows if d is not None and d % 3 == 0}
        marks = spark.createDataFrame([(d,) for d in trusted], "doc_id bigint")
        want = brute.ratios(rows, trusted, buckets, PRIOR)
        got = quality_rules(df.withColumn("__id", F.lit("clash")), marks, buckets=buckets).collect()
        assert sorted((r.doc_id is None, r.doc_id, r.n_words) for r in got) == sorted(
            (d is None, d, len(brute.words(t))) for d, t in rows
        )
        near = sorted(((d is None, d or 0, len(brute.words(t))), x) for (d, t), x in zip(rows, want, strict=True))
        mine = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words), r.llr) for r in got)
        assert [x for _, x in mine] == pytest.approx([x for _, x in near], abs=2e-6)
        assert all(r.kept == (not r.base_failed and r.llr >= -0.15) for r in got if abs(r.llr + 0.15) > 1e-5)


def test_quality_ratio_keeps_the_trusted_kind(spark):
    good = [(i, " ".join(f"good{(i * 7 + j) % 50}" for j in range(30))) for i in range(60)]
    junk = [(100 + i, " ".join(f"junk{(i * 7 + j) % 50}" for j in range(30))) for i in range(60)]
    df = frame(spark, good + junk)
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id bigint")
    got = {r.doc_id: r for r in quality_rules(df, trusted).collect()}
    assert all(got[i].kept for i, _ in good) and not any(got[i].kept for i, _ in junk)
    none = quality_rules(df, trusted.limit(0)).collect()
    assert all(r.llr == 0.0 and r.kept for r in none)


# --- op6 ------------------------------------------------------------------

def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models

    from codicil.llm.tokencount import default_path as pieces_path

    pieces = pieces_of(pieces_path())
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    for rows, df in inputs(spark):
        want = [(d, len(brute.words(t)), sum(len(library.encode("▁" + w).ids) for w in brute.words(t))) for d, t in rows]
        assert rows_of(token_counts(df), "doc_id", "n_words", "n_tokens") == sorted(want, key=repr)


def whole_library():
    """A unigram library with byte fallback over the vocabulary file."""
    from tokenizers import Tokenizer, models

    from codicil.llm.tokencount import default_path as pieces_path

    pieces = [("<unk>", 0.0), *pieces_of(pieces_path()), *[(f"<0x{b:02X}>", 0.0) for b in range(256)]]
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    return lambda t: len(library.encode("▁" + t.replace(" ", "▁")).ids) if t else 0


def test_whole_texts_count_as_in_the_library(spark):
    count = whole_library()
    for rows, df in inputs(spark):
        want = [(d, len(brute.words(t)), count(t or "")) for d, t in rows]
        assert rows_of(token_counts(df, whole_text=True), "doc_id", "n_words", "n_tokens") == sorted(want, key=repr)


def test_query_counts_blanks_line_breaks_and_bytes(spark):
    from codicil.llm.queries import QUERIES

    count = whole_library()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in QUERIES["op6_token_counts"](spark, SMALL).collect()}
    assert got == {r.doc_id: count(r.text or "") for r in docs}


def test_random_whole_texts_against_both_libraries():
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    from codicil.llm.tokencount import counter
    from codicil.llm.tokencount import default_path as pieces_path

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    sp = SentencePieceProcessor(model_proto=model.SerializeToString())
    read, count, draw = counter(pieces_path(), True), whole_library(), random.Random(4)
    for text, tokens in [("龘龘龘", 10), ("a\nb", 3), ("a\n\nb", 4), ("", 0)]:
        assert read.whole(text.encode())[0] == len(sp.encode(text)) == count(text) == tokens, text
    units = ["the", " ", "  ", "\n", "\t", "\r\n", "龘", "é", "▁", "();", "{", "}", "ing", "Q", "0", "🙂"]
    for _ in range(3000):
        text = "".join(draw.choice(units) for _ in range(draw.randint(0, 25)))
        assert read.whole(text.encode())[0] == count(text), text


def test_pieces_across_blanks_are_read_whole():
    pieces = [("a", -1.0), ("b", -1.0), ("▁", -1.0), ("a▁b", -0.5)]
    assert UnigramCounter(pieces).whole(b"a b") == (2, 2)


def test_viterbi_ties_and_unknown_runs():
    count = UnigramCounter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -9.0)])
    assert count.word("ab") == 1  # equal scores: the longer last piece, found from the earlier start
    assert count.word("xyz") == 1 and count.word("axxb") == 3
    assert count.word("abc") == 1


# --- op8 ------------------------------------------------------------------

def test_near_dedup_equals_brute_force(spark):
    for rows, df in inputs(spark):
        got = rows_of(near_dedup(df), "doc_id", "n_shingles", "component_id")
        assert got == sorted(brute.near(rows), key=repr)


def test_near_links_at_the_bound_and_in_chains(spark):
    """Sets around the bound, of light and heavy sizes, and chains whose ends do not link."""
    draw, rows = random.Random(11), []
    for size in (6, 7, 8, 9, 11, 12, 14, 19, 24, 27, 40, 90):
        base = [f"k{size}_{i}" for i in range(size)]
        for _ in range(7):
            edit = list(base)
            for _ in range(draw.randrange(0, max(2, size // 6))):
                edit[draw.randrange(len(edit))] = f"z{draw.random()}"
            rows.append((len(rows), " ".join(edit[draw.randrange(2) :])))
            base = edit if draw.random() < 0.5 else base
    got = rows_of(near_dedup(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.near(rows), key=repr)


def test_a_crowded_passage_and_a_large_near_group(spark):
    line = " ".join(f"l{i}" for i in range(30))
    rows = [(i, f"{line} " + " ".join(f"o{i}_{j}" for j in range(25))) for i in range(300)]
    base = [f"g{i}" for i in range(80)]
    rows += [(1000 + i, " ".join(base[:40] + [f"m{i}"] + base[41:])) for i in range(300)]
    got = {r.doc_id: r.component_id for r in near_dedup(frame(spark, rows)).collect()}
    assert all(got[i] == i for i in range(300)) and all(got[1000 + i] == 1000 for i in range(300))


def test_representatives_have_all_columns(spark):
    df = frame(spark)
    kept = keep_representatives(df)
    assert kept.columns == df.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert {1, 2, 3, 4, 5, 8, 11, 17} <= set(ids) and not {6, 7, 12, 18} & set(ids)


def test_one_row_stands_for_a_component(spark):
    """Null and repeated ids: equal rows, an id in two components, and null ids beside a wordless row without id."""
    base = [f"b{i}" for i in range(60)]
    near = " ".join([*base[:59], "other"])
    far = " ".join(f"f{i}" for i in range(60))
    alone = " ".join(f"a{i}" for i in range(60))
    base = " ".join(base)
    rows = [(1, base), (1, base), (2, near), (3, far), (2, far), (3, alone), (None, near), (None, None), (None, " "), (None, None)]
    rows += [(2, alone + " more"), (None, "without any id here"), (None, "without any id here")]
    got = collections.Counter((r.doc_id, r.text) for r in keep_representatives(frame(spark, rows)).collect())
    assert got == {
        (1, base): 1, (2, far): 1, (2, alone + " more"): 1, (None, None): 2, (None, " "): 1, (None, "without any id here"): 1,
    }


# --- op9 ------------------------------------------------------------------

TRICKY = [
    "a@b.cd%x@e.f and x..y@z-1.co.uk, no@dot, 1.2.3.4.5.6.7.8 999.1.1.1 0001.002.03.255",
    "card 4111 1111 1111 1111 then 4111-1111-1111-1112 and 4111111111111111 1",
    "+49 (30) 123456789 +1+2 +123 +44 20 7946 0958. tel +1 (555",
    "IBAN GB82 WEST 1234 5698 7654 32 or DE89370400440532013000, not GB82 WEST 1234 5698 7654 33",
    "my ssn is 123-45-6789; then, far from any such word, follows an order 123-45-6789",
    "é🙂 mail ünï@x.de 🙂 a@b.de",
    "9" * 3000 + "." + "a" * 3000 + "@",
]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = [*ROWS, *[(100 + i, t) for i, t in enumerate(TRICKY)]]
    for rows, df in [(rows, frame(spark, rows)), (small_rows(), spark.read.parquet(f"{SMALL}/documents.parquet"))]:
        want = []
        for d, t in rows:
            spans = brute.base_spans(t)
            counts = [sum(k == kind for k, _, _ in spans) for kind in brute.PII]
            want.append((d, *counts, brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
        got = rows_of(pii_report(df), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
        assert got == sorted(want, key=repr)


def test_added_kinds_need_their_checksum_or_context(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    got = {r.doc_id: r.spans for r in pii_report(frame(spark, rows)).collect()}
    assert [s.split(":")[0] for s in got[3].split(",")].count("iban") == 2
    assert got[4] == "ssn:10:21"
    scores = {s.value: s.score for r in find_pii(frame(spark, rows)).where("doc_id = 1").collect() for s in r.found}
    assert scores["4111 1111 1111 1111"] > 0.9


def test_masking_replaces_found_values(spark):
    rows = [(1, "write to a@b.de or +49 30 123456789 now"), (2, None), (3, "nothing")]
    got = {r.doc_id: r.masked for r in masked(frame(spark, rows)).collect()}
    assert got == {1: "write to <email> or <phone> now", 2: "", 3: "nothing"}


# --- op10 -----------------------------------------------------------------

@pytest.mark.parametrize("hot_share", [1, 10, 4096])
def test_exact_dedup_equals_brute_force(spark, hot_share):
    """With no text, some texts and every text dealt over sub-ranges."""
    for rows, df in inputs(spark):
        got = rows_of(exact_dedup(df, hot_share=hot_share), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert got == sorted(brute.exact(rows), key=repr)


def test_a_hot_text_is_split_and_keeps_its_least_id(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot  text").otherwise(F.concat(F.lit("t"), "id")).alias("text")
    )
    got = exact_dedup(df).where("group_size > 1").agg(F.min("keep_id"), F.max("keep_id"), F.count("*"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (0, 0, 1000, 1)


def test_groups_come_from_sorted_neighbours(spark, monkeypatch):
    """The runs decide: with every row a run of its own, no group is left."""
    from codicil.llm import exact_dedup as module

    df = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 50).cast("string").alias("text"))
    assert {r.group_size for r in exact_dedup(df, hot_share=1).collect()} == {4}
    real = module.Window.partitionBy
    monkeypatch.setattr(module.Window, "partitionBy", staticmethod(lambda *c: real(*c, "id")))
    assert {r.group_size for r in exact_dedup(df, hot_share=1).collect()} == {1}


def test_kept_rows_do_not_depend_on_order_or_names(spark):
    """Of rows equal in id and text the same one stays in any order; columns may have the names used inside."""
    rows = [(1, "a b c d e f", f"x{i}") for i in range(6)] + [(2, "a b c d e f", "y"), (3, "other words", "z")]
    names = ["__id", "__digest", "__several", "row", "digest", "kept_id", "n", "t1", "several", "id"]
    pick = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id bigint, text string, extra string").repartition(3)
        for name in names:
            df = df.withColumn(name, F.lit(f"clash {name}"))
        for keep in (keep_one, keep_representatives):
            kept = keep(df)
            assert kept.columns == df.columns
            pick.append(sorted(kept.collect()))
            assert [(r.doc_id, r.extra[0], r["__id"]) for r in pick[-1]] == [(1, "x", "clash __id"), (3, "z", "clash __id")]
    assert pick[0] == pick[2] and pick[1] == pick[3]


def test_kept_rows_are_whole(spark):
    df = frame(spark)
    kept = keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i) == sorted({d for d, k, _, keep, _ in brute.exact(ROWS) if keep and d})
