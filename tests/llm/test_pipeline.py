"""The pipeline against a brute-force version of each stage on its own input."""

import hashlib
import random

import pytest

pytest.importorskip("strandwise.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_dedup_ops import brute_removed, shingles, split  # noqa: E402
from test_easy_ops import reference_targets  # noqa: E402


def make(spark, path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeèfg") for _ in range(rng.randint(1, 6)))
    shared = " ".join(word() for _ in range(60))
    rows = []
    for i in range(150):
        t = " ".join(word() for _ in range(rng.randint(0, 60)))
        if i % 5 == 0 and rows:
            t = rng.choice(rows)[1] or ""
            t += " tail" if rng.random() < 0.5 else ""
        if i % 7 == 0:
            t += " " + shared
        rows.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "hot", "hot", None]), len(t)))
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, "12 ... 34", "en", "s2", 9), (203, "a b c d " * 8000, "en", "s1", 9)]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    return rows, df


def test_stages(spark, tmp_path):
    sf = f"{tmp_path}"
    rows, docs = make(spark, sf)
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == names
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]
        key = lambda r: str(r)
        if k == 0:
            assert sorted(after, key=key) == sorted((r for r in before if any(c.isalpha() for c in r[1] or "")), key=key)
        elif k == 1:
            sets = {r[0]: shingles(r[1]) for r in before}
            group = {i: i for i in sets}
            for a in sorted(sets):
                for b in sorted(sets):
                    if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and group[a] != group[b]:
                        old, new = max(group[a], group[b]), min(group[a], group[b])
                        group = {i: new if g == old else g for i, g in group.items()}
            assert sorted(r[0] for r in after) == sorted(i for i, g in group.items() if i == g)
            assert set(after) <= set(before)
        elif k == 2:
            want = brute_removed(before)
            assert {r[0]: b" ".join(split(r[1])) for r in after} == {i: w[2] for i, w in want.items()}
            assert {r[0]: r[1] for r in after if not want[r[0]][1]} == {r[0]: r[1] for r in before if not want[r[0]][1]}
        elif k == 3:
            sizes, got = {}, {}
            for r in before:
                sizes[r[3]] = sizes.get(r[3], 0) + len(split(r[1]))
            longest = max(len(split(r[1])) for r in before)
            for r in after:
                got[r[3]] = got.get(r[3], 0) + len(split(r[1]))
            for s, want in reference_targets(sizes).items():
                assert want - 1 <= got.get(s, 0) <= want + longest
            assert set(after) <= set(before) and max(after.count(r) for r in set(after)) <= 2
        else:
            assert sorted((r[0], r[3]) for r in after) == sorted((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in before)
        docs = out
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_pass_extra_columns_of_any_name(spark):
    names = ["lang_pred", "score", "_text", "_copies", "_epoch", "key", "_key", "row", "kept", "class", "size"]
    rows = [(1, "a b c d e f", "en", "s", 11, *range(11)), (2, "a b c d e f", "en", "s", 11, *range(11)), (3, "g h i j", None, "t", 7, *range(11)), (None, "k l m n o p", "en", None, 11, *range(11))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert {r[5:] for r in got} == {tuple(range(11))}
        if k < 3:
            assert sorted(r[0] or 0 for r in got) == ([0, 1, 2, 3] if k == 0 else [0, 1, 3] if k == 1 else [0, 1, 2, 3])
    assert corpus_pipeline.encode(spark, docs, "").count() == 4
