"""Plain-Python versions of the operators, and a small table of awkward rows."""

import collections
import hashlib
import math
import re
from collections import defaultdict, deque

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(50))
#: doc_id, text: nulls, empties, blanks only, very long, ties, repeated rows, shared passages, near copies.
ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b "),
    (4, LONG),
    (5, "one two three"),
    (6, "One  two\nthree"),
    (7, "one two three"),
    (7, "one two three"),
    (8, f"start {PASSAGE} end of eight"),
    (9, f"other words here {PASSAGE}"),
    (10, f"{PASSAGE} tail"),
    (None, "a row without an id that has some words in it to be read"),
    (None, "a row without an id that has some words in it to be read"),
    (11, " ".join(f"n{i}" for i in range(40))),
    (12, " ".join(f"N{i}" for i in range(40)) + " extra"),
    (13, " ".join(f"n{i}" for i in range(20)) + " cut " + " ".join(f"n{i}" for i in range(20, 40))),
    (14, "é́ ß ſ İstanbul ΑΣ 漢字 🙂 <|endoftext|> x<|startoftext|>y"),
    (15, "line one here\nline one here\n\nline one here\nother"),
    (16, "a b c d e a b c d e a b c d e"),
    (17, "word"),
    (18, "WORD"),
    (19, " ".join(["same"] * 90)),
    (20, "x" * 5000),
]


def frame(spark, rows=ROWS, clash=True):
    """Rows as a table; with columns whose names the operators use inside."""
    df = spark.createDataFrame([(i, t, f"s{k % 3}" if k % 7 else None) for k, (i, t) in enumerate(rows)],
                               "doc_id bigint, text string, source string")
    if clash:
        from pyspark.sql import functions as F

        for name in ("id", "size", "n", "v", "words", "bucket", "count", "kept", "score", "label", "pattern", "content"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut_repeats(rows, width=35):
    seen = collections.Counter()
    for _, t in rows:
        w = words(t)
        seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def base_rules(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    n = len(w)
    return (
        n,
        sum(map(len, w)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
        n < 10 or 100 * len(covered) > 20 * n,
    )


def shingles(text):
    w = words((text or "").translate(FOLD))
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def near(rows):
    """(id, set size, component) per row; rows are vertices, so null and repeated ids link like others."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        r = root(k)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, len(sets[k]), least.get(root(k)) if sets[k] else d) for k, (d, _) in enumerate(rows)]


def exact(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = []
    for content, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = min(known) if known else None
        turn = 0
        for d in ids:
            turn += d == keep
            out.append((d, keep, len(ids), d == keep and turn == 1, sha(content)))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()]
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
    return 12 <= len(digits) <= 19 and total % 10 == 0


def base_spans(text):
    good = {
        "email": lambda v: True,
        "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": luhn,
        "phone": lambda v: 9 <= sum(c.isdigit() for c in v) <= 15,
    }
    found = [
        (m.start(), k, kind, m.end())
        for k, (kind, pattern) in enumerate(PII.items())
        for m in re.finditer(pattern, text or "")
        if good[kind](m.group())
    ]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


class Network:
    """Directed network for blocking-flow augmentation."""

    def __init__(self, nodes: int) -> None:
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def add(self, a: int, b: int, room: int) -> int:
        self.edges[a].append(len(self.to))
        self.edges[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [room, 0]
        return len(self.to) - 2

    def push(self, source: int, sink: int) -> None:
        """Route as much more as fits."""
        while True:
            level = [-1] * len(self.edges)
            level[source] = 0
            queue = deque([source])
            while queue:
                a = queue.popleft()
                for e in self.edges[a]:
                    if self.room[e] and level[self.to[e]] < 0:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if level[sink] < 0:
                return
            at = [0] * len(self.edges)
            while path := self._path(source, sink, level, at):
                least = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= least
                    self.room[e ^ 1] += least

    def _path(self, source: int, sink: int, level: list[int], at: list[int]) -> list[int]:
        path: list[int] = []
        a = source
        while a != sink:
            while at[a] < len(self.edges[a]):
                e = self.edges[a][at[a]]
                if self.room[e] and level[self.to[e]] == level[a] + 1:
                    path.append(e)
                    a = self.to[e]
                    break
                at[a] += 1
            else:
                if a == source:
                    return []
                e = path.pop()
                a = self.to[e ^ 1]
                at[a] += 1
        return path


def route(cells: dict[tuple[str, str], tuple[int, int]], quotas: dict[str, int], repeats: int = 2) -> dict:
    """Words taken per (pattern, source).

    ``cells`` gives the words of the rows of a source whose texts have that
    pattern, and the words of the pattern's texts counted once. A pattern's texts
    cost nothing the first time, 1 the second, 2 the third and so on: its capacity
    at each price is its once-counted words. Prices stand at the patterns alone, so
    routing all that fits at one price before opening the next is a least-cost flow.
    A cell takes ``repeats`` times its words at most, a source its quota.
    """
    patterns = sorted({p for p, _ in cells})
    sources = sorted(quotas)
    node = {("p", p): 2 + i for i, p in enumerate(patterns)}
    node |= {("s", s): 2 + len(patterns) + i for i, s in enumerate(sources)}
    net = Network(2 + len(node))
    once, most = {}, defaultdict(int)
    arcs = {}
    for (p, s), (size, unique) in sorted(cells.items()):
        once[p] = max(unique, 1)
        most[p] += repeats * size
        arcs[p, s] = net.add(node["p", p], node["s", s], repeats * size)
    for s in sources:
        net.add(node["s", s], 1, quotas[s])
    left = dict(most)
    while any(left.values()):
        step = {p: min(once[p], n) for p, n in left.items() if n}
        for p, n in step.items():
            net.add(0, node["p", p], n)
            left[p] -= n
        net.push(0, 1)
        if all(net.room[e] == 0 for s in sources for e in net.edges[node["s", s]] if net.to[e] == 1):
            break
    return {key: net.room[e ^ 1] for key, e in arcs.items()}


def code(value, seed=42):
    """Hash of a string or long as Spark's xxhash64 gives it, signed."""
    data = value.encode() if isinstance(value, str) else (value % (1 << 64)).to_bytes(8, "little")
    h = xxhash.xxh64_intdigest(data, seed % (1 << 64))
    return h - (1 << 64) if h >> 63 else h


def ratios(rows, trusted, buckets, prior):
    """Mean weight per hashed unigram and bigram of each text: the smoothed trusted share over the raw one."""
    grams = []
    for _, t in rows:
        codes = [code(w) for w in words(t)]
        grams.append([c % buckets for c in codes] + [code(b, code(a)) % buckets for a, b in zip(codes, codes[1:])])
    raw = collections.Counter(g for gs in grams for g in gs)
    good = collections.Counter(g for (d, _), gs in zip(rows, grams, strict=True) if d in trusted for g in gs)
    n, m = sum(raw.values()), sum(good.values())
    weight = {g: math.log((good[g] + prior * c / n) / (m + prior)) - math.log(c / n) if m else 0.0 for g, c in raw.items()}
    return [sum(weight[g] for g in gs) / len(gs) if gs else 0.0 for gs in grams]
