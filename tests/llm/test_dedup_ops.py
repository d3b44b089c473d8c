"""Operators 3 and 4 against brute force on rows made to repeat, with hard rows."""

import random

import pytest

pytest.importorskip("strandwise.llm")
from strandwise.llm import jaccard, substring  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, place string"


def corpus(seed, docs=150):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, k)))
    passages = [" ".join(word(6) for _ in range(rng.randint(15, 90))) for _ in range(12)]
    rows = []
    for i in range(docs):
        kind = rng.random()
        if kind < 0.1:
            t = " ".join(rng.choice(["x", "x", "x", "y"]) for _ in range(rng.randint(0, 90)))
        elif kind < 0.15:
            t = " ".join(["a", "b", "c"][: rng.randint(1, 3)] * rng.randint(1, 40))
        elif kind < 0.4 and rows:
            t = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.randint(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = word(6)
            t = " ".join(t)
        else:
            t = ""
            for _ in range(rng.randint(0, 4)):
                p = rng.choice(passages).split(" ")
                a = rng.randrange(len(p))
                t += " ".join(p[a : a + rng.randint(1, 90)]) + rng.choice([" ", "\t", "\n\n", " ", "\x1c"]) + " ".join(word(6) for _ in range(rng.randint(0, 12))) + " "
        rows.append((i, t, "en", "s", 0, "k", "p"))
    order = list(range(docs))
    rng.shuffle(order)
    rows = [(order[i], *r[1:]) for i, r in enumerate(rows)]
    return rows + [(docs + 1, None, None, None, None, None, None), (docs + 2, "", "en", "s", 0, "k", "p"), (docs + 3, "THE end.", "en", "s", 0, "k", "p"), (docs + 4, "the END.", "en", "s", 0, "k", "p"), (docs + 5, "w " * 30_000, "en", "s", 0, "k", "p")]


def split(text):
    return (text or "").encode().split()


def brute_removed(rows, n=20):
    first = {}
    for i, t, *_ in rows:
        w = split(t)
        for s in range(len(w) - n + 1):
            k = b" ".join(w[s : s + n])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = {}
    for i, t, *_ in rows:
        w = split(t)
        gone = set()
        for s in range(len(w) - n + 1):
            if first[b" ".join(w[s : s + n])] < (i, s):
                gone.update(range(s, s + n))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("seed,limit", [(1, 2000), (2, 2)])
def test_substring(spark, seed, limit, monkeypatch):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    if limit != 2000:
        whole = substring.removed_windows
        monkeypatch.setattr(substring, "removed_windows", lambda docs, n: whole(docs, n, shard_runs=limit))
    want = brute_removed(rows)
    assert sum(v[1] for v in want.values()) > 1000
    got = {r.doc_id: (r.n_words, r.n_removed, b" ".join(split(r.kept))) for r in substring.deduplicate(df).collect()}
    assert got == want


def test_substring_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(None, t), (5, t), (5, t), (9, t + " tail"), (3, "short one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_words, r.n_removed) for r in substring.deduplicate(df).collect())
    assert got == [(3, 2, 0), (5, 40, 0), (5, 40, 0), (9, 41, 40), (99, 40, 40)]
    assert substring.deduplicate(df.limit(0)).count() == 0


def test_automaton_and_known(spark):
    rng = random.Random(4)
    for _ in range(200):
        seqs = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(3)]
        a = substring.SuffixAutomaton()
        for s in seqs:
            a.add(s)
        q = [rng.choice("abcd") for _ in range(15)]
        inside = lambda x: any(s[i : i + len(x)] == x for s in seqs for i in range(len(s) - len(x) + 1))  # noqa: B023, E731
        assert a.statistics(q) == [max(k for k in range(e + 2) if k == 0 or inside(q[e + 1 - k : e + 1])) for e in range(len(q))]
    ref = [" ".join(f"r{i}" for i in range(60)), None, ""]
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"r{i}" for i in range(10, 45)) + " z"), (2, None), (3, "r1 r2 r3")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in substring.remove_known(docs, ref, shard_words=50).collect()}
    assert got == {1: [(2, 35)], 2: [], 3: []}


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("grams", [500_000, 300])
def test_jaccard(spark, grams):
    rows = corpus(7, 220)
    rows += [(1000 + i, " ".join([*(f"v{j}" for j in range(120)), *(f"u{i}x{j}" for j in range(i % 7))]), "en", "s", 0, "k", "p") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sets = {r[0]: shingles(r[1]) for r in rows}
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])} for i in sets}
    best = {i: i for i in sets}
    while True:
        new = {i: min([best[i], *(best[j] for j in links[i])]) for i in sets}
        if new == best:
            break
        best = new
    got = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in jaccard.similar(df, block_grams=grams).collect()}
    assert got == {i: (len(sets[i]), len(links[i]), best[i]) for i in sets}


def test_jaccard_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(None, t), (5, t), (5, t), (4, None), (3, " "), (8, "a b"), (9, "A  B"), (10, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(jaccard.similar(df).collect(), key=str)
    assert sorted((r.doc_id or -1, r.n_shingles, r.n_similar, r.component_id) for r in got) == [(-1, 36, 2, 5), (3, 0, 0, 3), (4, 0, 0, 4), (5, 36, 2, 5), (5, 36, 2, 5), (8, 1, 1, 8), (9, 1, 1, 8), (10, 1, 0, 10)]
    assert jaccard.similar(df.limit(0)).count() == 0


def test_divide_skip_keeps_every_member():
    import numpy as np

    rng = np.random.default_rng(2)
    base = np.arange(100, 160)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.95], rng.integers(0, 90, 3)])).astype(np.uint64) for _ in range(80)]
    sets.sort(key=len)
    lists = jaccard.InvertedLists(sets)
    for t in (1, 5, 40, 52, 55):
        for i, s in enumerate(sets):
            want = [(j, len(np.intersect1d(s, sets[j]))) for j in range(i) if len(np.intersect1d(s, sets[j])) >= t]
            assert lists.search(s, t, i) == want


def test_parts_are_shared_by_all_linked_sets():
    import numpy as np

    rng = np.random.default_rng(6)
    for percent in (60, 90, 97):
        for n in (2, 9, 10, 11, 19, 20, 60, 400, 3000):
            for _ in range(30):
                base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                less = int(rng.integers(0, 1 + n * (100 - percent) // 100))
                other = np.delete(base, rng.integers(0, len(base), less))
                more = n * (100 - percent) // 200
                other = np.unique(np.concatenate([other, rng.integers(0, 2**64, more, dtype=np.uint64)]))
                both = len(np.intersect1d(base, other))
                if len(other) and 100 * both >= percent * (len(base) + len(other) - both) and both < max(len(base), len(other)):
                    keys, owner = jaccard.part_keys(np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)]), percent)
                    assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size


def test_few_sets_of_few_parts():
    """Sets with hashes in one range have nearly all parts empty, and agree in those alone."""
    import numpy as np

    a = np.arange(100, 200, dtype=np.uint64)
    b = np.concatenate([a[:96] + np.uint64(1 << 63), a[96:]])
    c = np.concatenate([a[:96] + np.uint64(1 << 63), a[:1] + np.uint64(1 << 62)])
    for x, y in ((b, np.delete(b, 3)), (c, np.delete(c, 3))):
        x, y = np.sort(x), np.sort(y)
        keys, owner = jaccard.part_keys(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 90)
        assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size


def test_texts_that_share_lines_do_not_chain(spark, monkeypatch):
    """Nearly every n-gram occurs in several texts, but no two are alike: no component may grow with the table."""
    rng = random.Random(9)
    lines = [" ".join(f"l{i}w{j}" for j in range(60)) for i in range(300)]
    rows = [(i, " ".join(rng.sample(lines, 6))) for i in range(200)]
    sizes, whole = [], jaccard.components

    def watch(edges):
        out = whole(edges)
        sizes.append(max((r["count"] for r in out.groupBy("component").count().collect()), default=0))
        return out

    monkeypatch.setattr(jaccard, "components", watch)
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_similar == 0 for r in got)
    assert sizes[0] < 10


def test_bits_count_as_divide_skip(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(8)
    base = np.arange(1000, 1200)
    sets = [np.unique(np.concatenate([base[rng.random(200) < 0.97], rng.integers(0, 900, 3)])).astype(np.uint64) for _ in range(90)]
    args = np.arange(90) + 7, rng.integers(1, 4, 90), rng.integers(0, 2, 90), sets, 90
    for across in (False, True):
        monkeypatch.setattr(jaccard, "MOST_WORDS", 1 << 28)
        found = sorted(jaccard.tile_links(*args, across))
        monkeypatch.setattr(jaccard, "MOST_WORDS", 0)
        assert found and found == sorted(jaccard.tile_links(*args, across))


def test_rows_alone_in_their_group_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)), "s") for i in range(120)]
    rows += [(200, rows[3][1], "s"), (201, rows[3][1] + " w", "t"), rows[7], rows[7], (None, None, None), (None, None, None), (202, "", None)]
    docs, shuffled = spark.createDataFrame(rows, "doc_id long, text string, source string"), []
    whole = type(docs).dropDuplicates
    monkeypatch.setattr(type(docs), "dropDuplicates", lambda self, *a: shuffled.append(self.count()) or whole(self, *a))
    want = [r for r in dict.fromkeys(rows) if r[0] not in (200, 201)]
    for bits, most in ((24, 20), (6, len(rows))):
        monkeypatch.setattr(jaccard, "ROW_BITS", bits)
        assert sorted(map(tuple, jaccard.distinct_documents(docs).collect()), key=str) == sorted(want, key=str)
        assert 8 <= shuffled.pop() <= most
