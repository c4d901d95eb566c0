"""Toxicity, mixing, chat formatting, components, the pipeline and the registry."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codicil.llm.chat import chat_format
from codicil.llm.components import components
from codicil.llm.mixing import REPEATS, SHARE, mix, mixed_rows, route_cells, targets
from codicil.llm.queries import ORACLES, QUERIES
from codicil.llm.toxicity import LandmarkKernel, fit_words, held_out, kept_by_score, toxicity
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.brute import ROWS, frame, route

# --- op5 ------------------------------------------------------------------

INSULTS = ["blockhead", "nitwit", "dunderhead", "scoundrel"]


def toxic_corpus(n=500):
    draw = random.Random(2)
    syllables = ["ar", "en", "sto", "li", "mu", "pra", "ton", "ves", "ki", "dol", "fe", "gan"]
    rows, labels = [], []
    for d in range(n):
        ws = ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(20, 120))]
        toxic = d % 5 == 0
        for _ in range(3 if toxic else 0):
            ws.insert(draw.randrange(len(ws)), draw.choice(INSULTS) + draw.choice(["", "s", "ly", "###"]))
        rows.append((d, " ".join(ws)))
        labels.append((d, int(toxic)))
    return rows, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumn("quality", F.lit(1))


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    want = dict(labels)
    got = toxicity(frame(spark, rows), label_frame(spark, labels)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and 80 < len(held) < 180
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_held_out_rows_follow_the_checksum(spark):
    import zlib

    got = spark.range(300).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = toxic_corpus(200)
    import zlib

    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y) for d, y in labels]
    one = {r.doc_id: r.score for r in toxicity(frame(spark, rows), label_frame(spark, labels)).collect()}
    two = {r.doc_id: r.score for r in toxicity(frame(spark, rows), label_frame(spark, flipped)).collect()}
    assert one == two


def test_awkward_rows_and_no_labels(spark):
    got = toxicity(frame(spark), label_frame(spark, [(1, 0)])).collect()
    assert len(got) == len(ROWS) and all(r.score == 0.0 and r.predicted == 0 for r in got)
    rows, labels = toxic_corpus(200)
    more = [(d if d is None else d + 10_000, t) for d, t in ROWS]
    got = toxicity(frame(spark, rows + more), label_frame(spark, labels)).collect()
    assert len(got) == len(rows) + len(more)
    assert not any(r.predicted for r in got if r.doc_id is None or r.doc_id >= 10_000)
    empty = toxicity(frame(spark, [(1, "x")]).limit(0), label_frame(spark, labels))
    assert empty.count() == 0


def test_gapped_words_score_like_the_insult():
    plain = ["".join(p) for p in itertools.product(["ar", "en", "sto", "li", "mu", "pra"], repeat=3)]
    model = fit_words([w + s for w in INSULTS for s in ("", "s", "ly")], plain)
    for word in ("blockhead", "block-head", "b.lockhead", "scoundrels", "scound*rel", "dunderheaded"):
        assert model.decide([word])[0] > 0, word
    assert (model.decide(plain) < 0).mean() > 0.99


def test_kernel_equals_its_definition():
    def features(word):
        out = collections.Counter()
        word = f"_{word}_"
        for at in itertools.combinations(range(len(word)), 4):
            if at[-1] - at[0] < 7:
                out["".join(word[i] for i in at)] += 0.6 ** (at[-1] - at[0] - 3)
        return out

    def norm(word):
        n = len(word) + 2
        return sum(0.6 ** (2 * (at[-1] - at[0] - 3)) for at in itertools.combinations(range(n), 4) if at[-1] - at[0] < 7) ** 0.5

    words = ["idiot", "trash", "thrash", "rash", "worthless"]
    got = LandmarkKernel(words[:3])(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words[:3]):
            fa, fb = features(a), features(b)
            assert got[i, j] == pytest.approx(sum(fa[k] * fb[k] for k in fa) / norm(a) / norm(b))


def test_rejected_documents_go_whole_rows_stay(spark):
    rows, labels = toxic_corpus(200)
    df = frame(spark, [*rows, (5000, None)])
    kept = kept_by_score(df, label_frame(spark, labels))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == df.columns and 5000 in ids
    scored = toxicity(df, label_frame(spark, labels)).where("predicted = 0")
    assert ids == {r.doc_id for r in scored.collect()}


# --- op7 ------------------------------------------------------------------

def test_targets_share_the_excess():
    assert targets([10, 100, 100], [5, 2, 1], 150) == pytest.approx([20, 130 * 2 / 3, 130 / 3])
    assert targets([], [], 0) == []
    got = targets([1, 1, 1000], [5, 2, 1], 1.5 * 1002)
    assert got == pytest.approx([2, 2, 1499])


def test_route_is_a_least_cost_flow():
    """Against every integer routing of a small network."""
    cells = {("A", "a"): (2, 2), ("AB", "a"): (2, 2), ("AB", "b"): (2, 2), ("B", "b"): (1, 1)}
    unique = {"A": 2, "AB": 2, "B": 1}

    def cost(flow):
        total = 0
        for p, u in unique.items():
            used = sum(n for (q, _), n in flow.items() if q == p)
            total += sum(k // u for k in range(used))
        return total

    for qa, qb in [(4, 3), (8, 2), (3, 5), (1, 1), (8, 6)]:
        got = route(cells, {"a": qa, "b": qb})
        assert got["A", "a"] + got["AB", "a"] == qa and got["AB", "b"] + got["B", "b"] == qb
        options = (dict(zip(cells, f, strict=True)) for f in itertools.product(*[range(REPEATS * s + 1) for s, _ in cells.values()]))
        fits = [f for f in options if f["A", "a"] + f["AB", "a"] == qa and f["AB", "b"] + f["B", "b"] == qb]
        assert cost(got) == min(map(cost, fits))


def flow_cost(used, unique):
    """Words times price, by pattern."""
    cost = 0
    for p, n in used.items():
        full, rest = divmod(n, max(1, unique[p]))
        cost += max(1, unique[p]) * full * (full - 1) // 2 + full * rest
    return cost


def test_flow_on_arrays_costs_what_route_costs():
    draw = random.Random(5)
    for _ in range(150):
        names = "abcde"[: draw.randint(1, 5)]
        cells, unique = {}, {}
        for p in {"".join(sorted(draw.sample(names, draw.randint(1, len(names))))) for _ in range(draw.randint(1, 12))}:
            unique[p] = draw.randint(0, 9)
            cells |= {(p, s): (unique[p] * draw.randint(1, 3), unique[p]) for s in p}
        quotas = {s: draw.randint(0, 2 * sum(n for (_, t), (n, _) in cells.items() if t == s)) for s in names}
        keys, patterns = sorted(cells), sorted(unique)
        got = route_cells(
            np.array([patterns.index(p) for p, _ in keys]), np.array([names.index(s) for _, s in keys]),
            np.array([cells[k][0] for k in keys]), np.array([cells[k][1] for k in keys]), np.array([quotas[s] for s in names]),
        )
        assert all(0 <= n <= REPEATS * cells[k][0] for k, n in zip(keys, got, strict=True))
        costs = []
        for flow in (route(cells, quotas), dict(zip(keys, got.tolist(), strict=True))):
            used, filled = collections.Counter(), collections.Counter()
            for (p, s), n in flow.items():
                used[p] += n
                filled[s] += n
            costs.append((flow_cost(used, unique), sum(filled.values())))
        assert costs[0] == costs[1]


def test_rare_patterns_are_priced_as_shared(spark):
    """The whole mix costs what the network flow of the pattern table costs: texts count once over all their sources."""
    draw = random.Random(8)
    rows, held = [], {}
    for t in range(60):
        text = " ".join(f"t{t}w{i}" for i in range(draw.randint(5, 40)))
        held[text] = draw.sample("abcdef", draw.randint(1, 5))
        rows += [(len(rows) + i, text, s) for i, s in enumerate(held[text])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    unique = collections.Counter()
    for text, sources in held.items():
        unique["".join(sorted(sources))] += len(text.split())
    cells = collections.Counter()
    for text, sources in held.items():
        for source in sources:
            cells["".join(sorted(sources)), source] += len(text.split())
    sizes = {x: sum(n for (_, y), n in cells.items() if y == x) for x in "abcdef"}
    goal = targets(list(sizes.values()), [5, 2, 1, 5, 2, 1], SHARE * sum(sizes.values()))
    quotas = {x: min(round(t), REPEATS * sizes[x]) for x, t in zip(sizes, goal, strict=True)}
    least = route({k: (n, unique[k[0]]) for k, n in cells.items()}, quotas)
    taken = {r.doc_id: r.taken for r in mix(df).collect()}
    assert len(taken) == len(rows)
    costs = []
    for flow in (
        [(p, n) for (p, _), n in least.items()],
        [("".join(sorted(held[text])), taken[d]) for d, text, _ in rows],
    ):
        used = collections.Counter()
        for p, n in flow:
            used[p] += n
        costs.append((flow_cost(used, unique), sum(used.values())))
    assert costs[0] == costs[1]


def test_mix_meets_its_targets(spark):
    for df in (spark.read.parquet(f"{SMALL}/documents.parquet"), frame(spark), frame(spark, [(1, "x")]).limit(0)):
        rows = df.select("doc_id", "text", "source").collect()
        got = mix(df).collect()
        assert len(got) == len(rows)
        names = sorted({r.source for r in rows if r.source is not None}) + [None] * any(r.source is None for r in rows)
        sizes = collections.Counter()
        for r in rows:
            sizes[r.source] += len(brute.words(r.text))
        want = targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], SHARE * sum(sizes.values()))
        assert all(0 <= r.taken <= 2 * r.size for r in got)
        taken = collections.Counter()
        for r in got:
            taken[round(r.target, 6), r.source_size] += r.taken
        expected = collections.Counter()
        for s, t in zip(names, want, strict=True):
            expected[round(t, 6), sizes[s]] += t
        assert taken.keys() == expected.keys()
        assert all(abs(taken[k] - expected[k]) <= len(names) for k in taken)
        key = lambda r: (r.doc_id is None, r.doc_id, r.taken)
        assert sorted(got, key=key) == sorted(mix(df).collect(), key=key)


def test_mixed_rows_hold_the_words_taken(spark):
    df = frame(spark)
    out = mixed_rows(df)
    assert out.columns == df.columns
    total = sum(len(brute.words(r.text)) for r in out.collect())
    assert total == sum(r.taken for r in mix(df).collect())
    whole = {t for _, t in ROWS}
    assert sum(r.text not in whole for r in out.collect()) <= 8


def test_repeated_rows_share_what_is_taken(spark):
    """A row that most of a source repeats comes as often as the mix takes it, however it is portioned."""
    rows = [(1, "one two three four", "a")] * 500 + [(d, f"w{d} x y", "a") for d in range(2, 40)] + [(99, "b " * 40, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for name in ("key", "row", "taken", "copies", "share", "__take", "words"):
        df = df.withColumn(name, F.lit("clash"))
    want = sum(r.taken for r in mix(df).collect())
    out = mixed_rows(df, portion=7)
    assert out.columns == df.columns
    got = out.collect()
    assert sum(len(brute.words(r.text)) for r in got) == want and {r["__take"] for r in got} == {"clash"}


def test_a_part_taken_keeps_its_line_breaks(spark):
    rows = [(d, "".join(f"{' ' * (i % 3)}d{d}w{i}\n\t" for i in range(30 + d)), f"s{d % 3}") for d in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    whole = {d: t for d, t, _ in rows}
    out = mixed_rows(df).collect()
    parts = [r for r in out if r.text != whole[r.doc_id]]
    assert parts and all(whole[r.doc_id].startswith(r.text) for r in parts)
    assert sum(len(brute.words(r.text)) for r in out) == sum(r.taken for r in mix(df).collect())


# --- op4 ------------------------------------------------------------------

def chat_rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("place", F.lit("clash"))


def test_snapshots_collapse(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yes"), (3, 0, "user", "hi"), (3, 1, "bot", "yes")]
    rows += [(4, 0, "user", "hi"), (4, 1, "bot", "no"), (5, 7, None, None), (6, None, "user", "hi"), (6, 3, "bot", "yes"), (6, 4, "user", "more")]
    got = {r.conv_id: (r.n_turns, r.copies, r.rendered) for r in chat_format(chat_rows(spark, rows)).collect()}
    assert got == {
        4: (2, 1, "<|user|>\nhi\n<|end|>\n<|bot|>\nno\n<|end|>\n"),
        5: (1, 1, "<||>\n\n<|end|>\n"),
        6: (3, 1, "<|user|>\nhi\n<|end|>\n<|bot|>\nyes\n<|end|>\n<|user|>\nmore\n<|end|>\n"),
    }
    assert chat_format(chat_rows(spark, rows).limit(0)).count() == 0


def test_long_conversations_come_in_parts(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(25)] + [(2, t, "user", f"t{t}") for t in range(20)]
    got = chat_format(chat_rows(spark, rows), part_turns=10).orderBy("part").collect()
    assert [(r.conv_id, r.part, r.n_turns) for r in got] == [(1, 0, 25), (1, 1, 25), (1, 2, 25)]
    assert "".join(r.rendered for r in got) == "".join(f"<|user|>\nt{t}\n<|end|>\n" for t in range(25))


# --- components, registry, pipeline ----------------------------------------

def test_components_of_random_links(spark):
    draw = random.Random(9)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {v: v for e in links for v in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.v: r.comp for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {v: root(v) for v in parent if any(v in e and e[0] != e[1] for e in links)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_registry():
    from __spark_entry__ import queries

    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes, before = [docs.count()], docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, before, SMALL)
        assert after.columns == docs.columns
        after = after.cache()
        rows = [(r.doc_id, r.text) for r in before.collect()]
        kept = [(r.doc_id, r.text) for r in after.collect()]
        if name == "exact_dedup":
            assert sorted(d for d, _ in kept) == sorted(d for d, _, _, keep, _ in brute.exact(rows) if keep)
        if name == "near_dedup":
            assert sorted(d for d, _ in kept) == sorted(d for d, _, c in brute.near(rows) if d == c)
        if name == "mixing":
            target = SHARE * sum(len(brute.words(t)) for _, t in rows)
            assert abs(sum(len(brute.words(t)) for _, t in kept) - target) <= 25
        sizes.append(len(kept))
        before = after
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.count() == sizes[-1] and sizes[0] > sizes[1] > sizes[2] >= sizes[3]



@pytest.mark.parametrize("span", [1, 2, 7, 50_000])
def test_neighbourhoods_do_not_depend_on_the_span(monkeypatch, span):
    import pyarrow as pa

    from codicil.llm import toxicity as tox

    monkeypatch.setattr(tox, "_SPAN_WORDS", span)
    draw = random.Random(span)
    for n in (0, 1, 2, 3, 6, 7, 8, 15, 40):
        words = [draw.choice(["abc", "defg", "xy", "hijkl"]) for _ in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words)]), pa.array([1], pa.int32())], names=["text", "label"])
        out = list(tox._contexts(iter([batch, batch])))
        got = {x for o in out for x in zip(o.column(0).to_pylist(), o.column(2).to_pylist(), strict=True)}
        around = zip(["", *words], words, [*words[1:], ""], strict=False)
        assert got == {(w, f"{left} {right}") for left, w, right in around if len(w) >= 3}
        assert sum(o.column(1).to_pylist().count(1) for o in out) == sum(o.num_rows for o in out)
