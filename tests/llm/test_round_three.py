"""Sharding, collocations and the filter audit against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from codicil.llm import collocations as col
from codicil.llm import filter_audit as audit
from codicil.llm import queries
from codicil.llm import sharding
from tests.conftest import SMALL
from tests.llm.brute import FOLD, ROWS, frame, sha, words
from tests.test_parity import plain


@pytest.mark.parametrize("name", ["op11_sharding", "op12_collocations", "op13_filter_audit"])
def test_equal_to_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)


# --- op11 -----------------------------------------------------------------

def least_largest(sizes, shards):
    """Smallest largest run of a list cut into ``shards`` runs, by dynamic programming."""
    ends = list(itertools.accumulate(sizes, initial=0))
    best = ends
    for _ in range(shards - 1):
        best = [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))]
    return best[-1]


def line_of(spark, sizes):
    ends = itertools.accumulate(sizes)
    return sharding._Line(spark.createDataFrame([(s, 1, e) for s, e in zip(sizes, ends)], "bytes long, rows long, end long"))


def groups_of(rows):
    size = defaultdict(int)
    first = {}
    for i, t in rows:
        t = t or ""
        size[t] += len(t.encode()) + 1
        first[t] = min(first.get(t, (True, 0)), (i is None, i or 0))
    return [(t, size[t]) for t in sorted(size, key=lambda t: (first[t], sha(t)))]


@pytest.mark.parametrize("hot_share", [1, 4096])
def test_shards_hold_whole_groups_and_the_largest_is_least(spark, monkeypatch, hot_share):
    monkeypatch.setattr(sharding, "HOT_SHARE", hot_share)
    many = [(k, f"text {k * k % 37} " * (k % 11 + 1)) for k in range(200)]
    hot = [(k, "hot " * 20 if k % 3 == 0 else f"own {k}") for k in range(150)]
    for rows in (ROWS, many, hot, [(None, "a"), (None, "a"), (5, None)]) if hot_share > 1 else (hot,):
        got = sharding.shard_by_bytes(frame(spark, rows)).collect()
        text = {sha(t or ""): t or "" for _, t in rows}
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
            (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
        )
        assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
        for shard in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
        groups = groups_of(rows)
        held = defaultdict(int)
        shard_of = defaultdict(set)
        for r in got:
            held[r.shard] += r.size
            shard_of[r.text_crc32].add(r.shard)
        assert max(held.values()) == least_largest([s for _, s in groups], 8)
        assert all(len(s) == 1 for s in shard_of.values())
        in_order = [min(shard_of[zlib.crc32(t.encode())]) for t, _ in groups]
        assert in_order == sorted(in_order) and max(in_order) < 8 and len(text) == len(groups)


def test_sharding_of_an_empty_table(spark):
    assert sharding.shard_by_bytes(frame(spark).limit(0)).collect() == []


def test_capacity_of_random_lines(spark):
    draw = random.Random(3)
    for shards in (1, 3, 8):
        sizes = [draw.choice([1, 2, 5, 40, draw.randint(1, 5000)]) for _ in range(draw.randint(1, 60))]
        line = line_of(spark, sizes)
        capacity = sharding.smallest_capacity(line, shards)
        assert capacity == least_largest(sizes, shards)
        borders = [0, *sharding.cuts(line, shards), sum(sizes)]
        assert borders == sorted(borders) and set(borders) <= {0, *itertools.accumulate(sizes)}
        assert max(b - a for a, b in zip(borders, borders[1:])) == capacity


def test_cuts_are_even_where_one_group_sets_the_capacity(spark):
    assert sharding.cuts(line_of(spark, [70] + [10] * 14), 8) == [70, 90, 110, 130, 150, 170, 190]


def test_shards_are_written_with_clashing_columns(spark, tmp_path):
    docs = frame(spark, ROWS).withColumnRenamed("score", "shard").withColumnRenamed("label", "digest")
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r.row.doc_id, r.row.text, r.row.digest) for r in back) == Counter((i, t, "clash") for i, t in ROWS)
    assert {(r.row.doc_id, r.row.text, r.shard) for r in back} == {
        (i, t, s) for i, t in ROWS for s in {r.shard for r in back if r.row.text == t and r.row.doc_id == i}
    }


# --- op12 -----------------------------------------------------------------

def brute_counts(rows):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(5, len(w) - i) + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    return counts, totals


def brute_ranking(counts, totals, least, most, covered=100):
    out = []
    for lang in totals:
        f = {p: c for (g, p), c in counts.items() if g == lang and c >= least}
        rows = []
        for p, a in f.items():
            if len(p) < 2:
                continue
            score, _, l, r = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(
                len(q) > len(p) and 100 * c >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in f.items()
            )
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), " ".join(p), l, r))
        for rank, (score, a, _, p, l, r) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, p, -a, l, r, totals[lang], -score))
    return sorted(out)


def lang_rows(seed=4):
    draw = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "City", "a", "b\x01", "b", "b\x1f", "é", "漢字", "x" * 40, "z"]
    rows = [(draw.choice(["en", "de", None, "und", ""]), "".join(
        draw.choice(vocabulary) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b", "!"]) for _ in range(draw.randint(0, 60))
    )) for _ in range(120)]
    rows += [("en", "in the year of our lord " * 30), ("en", None), (None, ""), ("de", " \t ")] + [("fr", "same old words here again")] * 40
    return rows


@pytest.mark.parametrize("range_rows", [7, 1_500_000])
def test_collocations_equal_brute_force(spark, range_rows):
    rows = lang_rows()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "lang string, text string, phrase string, n string")
    counts, totals = brute_counts(rows)
    for least, most, covered in ((3, 2000, 100), (10, 5, 60)):
        got = col.collocations(df, least, most, covered, range_rows=range_rows).collect()
        assert sorted(map(tuple, got)) == brute_ranking(counts, totals, least, most, covered)
    assert col.collocations(df.limit(0)).collect() == []


def test_scores_pass_64_bits(spark):
    big = 9 * 10**15
    counts = [("en", "a", 1, big - 1), ("en", "b", 1, big - 7), ("en", "a b", 2, big - 11), ("en", None, 0, 5 * big + 3)]
    df = spark.createDataFrame(counts, col.PHRASES)
    (row,) = col.ranked_phrases(df, 10, 100).collect()
    assert row.score == 1000 * (big - 11) * (5 * big + 3) // ((big - 1) * (big - 7))


def test_quicksort_counts_every_frequent_run():
    draw = np.random.default_rng(2)
    for least in (1, 4, 30):
        columns = [draw.integers(1, 4, 300)]
        for _ in range(4):
            columns.append(np.where(columns[-1] > 0, draw.integers(0, 5, 300), 0))
        weights = draw.integers(1, 6, 300)
        want = Counter()
        rows = list(zip(*[c.tolist() for c in columns]))
        for row, w in zip(rows, weights.tolist()):
            for k in range(1, 6):
                if row[k - 1]:
                    want[row[:k]] += w
        got = dict(col.frequent_prefixes(columns, weights, least))
        edges = {row[:k] for row in (min(rows), max(rows)) for k in range(1, 6) if row[k - 1]}
        assert got == {p: c for p, c in want.items() if c >= least or p in edges}


def test_long_texts_are_cut_without_losing_a_suffix(monkeypatch):
    draw = random.Random(9)
    text = "".join(draw.choice(["ab", "c", "déf"]) + draw.choice([" ", " ", " ", "  ", ".", ", ", "\t"]) for _ in range(3000))
    whole = Counter()
    for blob, rest in col._slices([text.encode()]):
        found = col._Suffixes(blob, rest)
        whole.update(dict(zip(found.texts(found.rows).to_pylist(), found.counts.tolist())))
    monkeypatch.setattr(col, "_SLICE", 64)
    cut = Counter()
    slices = list(col._slices([text.encode(), b"", b"tail words"]))
    assert len(slices) > 50
    for blob, rest in slices:
        found = col._Suffixes(blob, rest)
        cut.update(dict(zip(found.texts(found.rows).to_pylist(), found.counts.tolist())))
    assert cut - whole == Counter({b"tail words": 1, b"words": 1}) and whole - cut == Counter()


# --- op13 -----------------------------------------------------------------

def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = words(t)
        fails = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "")
        fails += "C" if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else ""
        fails += "D" if re.search(r"[#$%&*|]", t) else ""
        fails += "E" if i is not None and least[t] < i else ""
        parts[s or ""].append((set(fails), i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = [d for d in docs if f in d[0] and not d[0] & set(order[:k])]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    sum(not d[0] & set(order[: k + 1]) for d in docs), len(gone),
                    sum(f in d[0] and bool(d[0] & set(order[:k])) for d in docs),
                    sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("hot_share", [1, 4096])
def test_audit_equals_brute_force(spark, monkeypatch, hot_share):
    monkeypatch.setattr(audit, "HOT_SHARE", hot_share)
    rows = [(i, t, f"s{k % 3}" if k % 7 else None) for k, (i, t) in enumerate(ROWS)]
    rows += [(40 + k, "Same TEXT & more", "s1") for k in range(30)] + [(40, "Same TEXT & more", "s2"), (None, "Same TEXT & more", "s1")]
    rows += [(90, " ".join(f"u{i}" for i in range(300)), ""), (91, " ".join(f"u{i}" for i in range(300)), None)]
    labels = [(1, 1, 0), (40, 1, 1), (41, 0, 1), (41, 1, 0), (91, 1, None), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, source string, part string, mask string")
    judged = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, source string")
    got = audit.filter_audit(docs, judged).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute_audit(rows, labels)
    assert len(got) == 600 * 4
    assert audit.filter_audit(docs.limit(0), judged).collect() == []


def test_audit_of_the_small_tables(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{SMALL}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SMALL}/labels.parquet'").fetchall()
    got = queries.QUERIES["op13_filter_audit"](spark, SMALL).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute_audit(rows, labels)
