"""Operators 5 to 10 against brute force, exact round trips and held-out accuracy, with hard rows."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("strandwise.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")
from strandwise.llm import bpe, chat, language, licenses, mixing, topk  # noqa: E402

HARD = [
    (1, "The MIT License. All rights reserved, ALL-rights  reserved!", "en", "a", 7, "x"),
    (2, None, "en", "a", 0, "x"),
    (3, "", None, None, 0, "x"),
    (4, "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\ncc by cc by nc", "fr", None, 9, "x"),
    (5, "word " * 40_000, "en", "b", 1, "x"),
    (6, "word " * 40_000, "en", "b", 1, "x"),
    (6, "word " * 40_000, "en", "b", 1, "x"),
    (7, "Ünïcode général public LICENSE general\tpublic license 　 1234 !!", "fr", "c", 1, "x"),
    (None, "no id  'll we've \n\n  x", None, "c", 1, "x"),
    (8, "12 34 ...", "en", "a", 1, "x"),
    (9, "SPDX-License-Identifier: MIT AND (\nrest", "en", "a", 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


def words5(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())


def test_licenses_brute_force(spark, hard):
    rows = licenses.scan(hard).collect()
    assert len(rows) == len(HARD)
    base = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}
    left = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows}
    for doc, text, *_ in HARD:
        w = words5(text)
        places = [(i, label) for p, label in base.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (doc, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))) in left
    by = {r.doc_id: r for r in rows}
    assert by[4].labels == "apache-2.0,cc-by,cc-by-nc,gpl-2.0-only,mit"  # an exception is no licence
    assert by[9].labels == "malformed" and by[9].score == 0
    assert all(0 <= r.score <= 1 for r in rows)
    assert licenses.scan(hard.limit(0)).count() == 0


def test_shunting_yard():
    assert licenses.to_postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.to_postfix("(a or b) and c") == ["a", "b", "or", "c", "and"]
    assert licenses.evaluate("MIT OR GPL-3.0") == (["mit", "gpl-3.0"], 1.0)
    assert licenses.evaluate("MIT AND GPL-3.0")[1] == 0.3
    for bad in ("", "and", "a and", "(a", "a)", "()", "a (b)"):
        with pytest.raises(ValueError):
            licenses.to_postfix(bad)


def reference_targets(sizes, share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        left = budget - sum(target.values())
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= most * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / sum(weight[x] for x in open_)
            break
        for s in over:
            target[s] = most * sizes[s]
        open_ -= over
    return target


def test_mixing(spark, hard):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 50), None, rng.choice(["s1", "s2", "s3", "s4", None, "hot", "hot", "hot"]), 0, "") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, rows_per_range=100).collect()
    again = mixing.mix(docs.repartition(7), rows_per_range=500).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == 3000
    source = {r[0]: r[3] for r in rows}
    sizes, taken = {}, {}
    for r in got:
        sizes[source[r.doc_id]] = sizes.get(source[r.doc_id], 0) + r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = reference_targets(sizes)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
    assert {s: abs(taken[s] - want[s]) < 1.001 for s in sizes} == dict.fromkeys(sizes, True)
    assert mixing.mix(hard).count() == len(HARD) and mixing.mix(hard.limit(0)).count() == 0
    assert mixing.mixed_documents(hard).columns == hard.columns


def test_topk(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.12, (700, 64))
    x[10:20] = x[0]
    rows = [(i, x[i].astype(np.float32).tolist(), 0) for i in range(700)]
    rows += [(900, None, 0), (901, [None] * 64, 0), (902, [float("nan")] * 64, 0), (903, [0.0] * 64, 0), (None, x[0].tolist(), 0), (950, [0.5, -0.5], 0), (951, [0.1, 0.1], 1), (952, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in topk.top_k(df.where("vec_id % 50 = 0"), df, rows=100, query_rows=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = {i: np.floor(256 * np.array(e, np.float32).astype(float)).astype(int) for i, e, _ in rows if i is not None and e and i not in (901, 902)}
    for q in [i for i in v if i % 50 == 0]:
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))[:5]
        assert sorted(got[q]) == [(n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert set(got) == {i for i in v if i % 50 == 0}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_bpe_is_tiktoken(spark, hard):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.load(path, public_tokenizers.PATTERN)
    assert sorted(mine.hash(k) for k in ranks) == list(range(len(ranks)))
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("abcdeeeiou  \n'stédßñ漢字🎉12,.") for _ in range(rng.randint(0, 300)))
        assert mine.encode(t) == want.encode_ordinary(t) and mine.decode(mine.encode(t)).decode() == t
    assert mine.encode("a" * 5000) == want.encode_ordinary("a" * 5000)
    got = bpe.digests(hard, path, public_tokenizers.PATTERN).collect()
    assert len(got) == len(HARD)
    texts = {r[0]: r[1] or "" for r in HARD}
    for r in got:
        ids = want.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    back = {r.doc_id: bytes(r.data).decode() for r in bpe.decode(bpe.encode(hard, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()}
    assert back == texts


def test_chat(spark):
    rng = random.Random(9)
    bits = ["</s>", "[INST]", "[/INST]", "\\", "\\[", "<", "]", "ok", "ß", "\n", "[ROLE x]", " word"]
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 0, None, None), (None, None, "assistant", "")]
    for c in range(30):
        for t in range(rng.randint(1, 60)):
            rows.append((c, t if c else 0, rng.choice(["user", "assistant", "system", "tool]\\[", ""]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))))
    rows.append((31, 0, "assistant", "long " * 50_000))
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat.chat_windows(df, budget=60, history=3, history_budget=40)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    assert max(r.n_windows for r in got.values()) > 3
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0], r[1].encode(), r[2].encode()))
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_windows(df.limit(0)).count() == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", language.held_out(F.col("doc_id"), 3, 1))
    got = language.predict(docs, language.fit(docs.where("NOT held_out")), ["doc_id", "held_out", "lang"])
    right, n = got.where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.9
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_hard(spark, hard):
    model = language.fit(hard)
    got = {(r.doc_id, r.lang_pred == "und") for r in language.predict(hard, model, ["doc_id"]).collect()}
    assert {(2, True), (3, True), (8, True), (7, False), (None, False), (5, False)} <= got
    assert language.fit(hard.limit(0)) is None
    assert {r.lang_pred for r in language.predict(hard, None, ["doc_id"]).collect()} == {"und"}
    assert language.predict(hard.limit(0), model, ["doc_id"]).count() == 0


def test_language_learns_from_whole_texts(spark):
    rows = [(i, lang, "lorem " * 4000 + words * 9000) for i in range(4) for lang, words in (("en", "the cat sat "), ("fi", "yksi kissat "))]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "yksi kissat")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.predict(docs, model, ["doc_id"]).collect()} == {1: "en", 2: "fi"}


def test_language_decisions_brute_force():
    rng = np.random.default_rng(3)
    langs = ["en", "de", "nl", "fr", "es", "it", "fi", "xx"]
    model = language.Model(rng.random((64, language.DIMS)).astype(np.float32), [langs[i % 8] for i in range(64)])
    margins = rng.normal(size=(400, len(model.families) + len(model.pairs)))
    got, score = model.decide(margins)
    for row, lang, s in zip(margins, got, score):
        family = model.families[max(range(len(model.families)), key=lambda k: row[k])]
        best = sorted(row[: len(model.families)])
        gap, votes, least = best[-1] - best[-2], dict.fromkeys(model.members[family], 0.0), {}
        for j, pair in enumerate(model.pairs):
            if pair[0] in votes:
                m = row[len(model.families) + j]
                for x, own in zip(pair, (m, -m)):
                    votes[x] += (own > 0) + 1e-3 * np.tanh(own)
                    least[x] = min(least.get(x, np.inf), own)
        want = max(votes, key=lambda x: votes[x])
        assert lang == want
        assert abs(s - 1 / (1 + np.exp(-2 * min(gap, 2 * least.get(want, np.inf))))) < 1e-9


def test_language_without_ids_and_with_copies(spark):
    rows = [(None, "en", f"the cat sat on the mat {i}") for i in range(900)] + [(None, "fr", f"le chat est sur le tapis {i}") for i in range(900)] + [(i, "de", f"die katze sitzt auf der matte {i}") for i in range(50)]
    rows += [(7, "fi", "yksi kissa istuu matolla")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    model = language.fit(docs, per_language=100)
    assert model.langs == ["de", "en", "fi", "fr"]
    asked = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "le chat est sur le tapis"), (3, "yksi kissa istuu matolla")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.predict(asked, model, ["doc_id"]).collect()} == {1: "en", 2: "fr", 3: "fi"}


@pytest.mark.parametrize(
    "line, labels, rate",
    [
        ("(SPDX-License-Identifier: MIT)", "mit", 1.0),
        ("SPDX-License-Identifier: MIT.", "mit", 1.0),
        ("The SPDX License Identifier list is long", "", 0.0),
        ("SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Zlib", "gpl-2.0-only,mit,zlib", 1.0),
        ("SPDX-License-Identifier: MIT. And more", "mit", 1.0),
        ("SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0 */", "gpl-2.0+", 0.65),
        ("SPDX-License-Identifier: (MIT", "malformed", 0.0),
        ("SPDX-License-Identifier:", "malformed", 0.0),
    ],
)
def test_license_expressions(line, labels, rate):
    import pyarrow as pa

    found = licenses.scan_texts(pa.array([line, None]), licenses.build_automaton())
    assert ",".join(sorted(found["labels"][0] or [])) == labels and abs((found["rate"][0] or 0.0) - rate) < 1e-9
    assert found["labels"][1] is None


def test_mixing_reruns_agree(spark):
    rows = [(5 if i < 60 else None if i < 120 else i, "w " * (i % 17), ["a", "b", None][i % 3]) for i in range(300)]
    want = None
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(1 + seed)
        got = sorted(map(tuple, mixing.mix(df, rows_per_range=20).collect()), key=str)
        docs = sorted(map(tuple, mixing.mixed_documents(df, rows_per_range=20).collect()), key=str)
        want = want or (got, docs)
        assert want == (got, docs)


def test_topk_of_one_id_and_of_large_components(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), *((i, [float(i), float(-i)]) for i in range(1, 9))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df.where("vec_id = 50"), df, k=2).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, -65536), (1, 8, 524288), (2, 2, -131072), (2, 7, 458752)]
    large = spark.createDataFrame([(50, [1e6 + 1, 3.0]), (1, [1e6 + 3, 1.0]), (2, [1e6 - 1, 7.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(large.where("vec_id = 50"), large).orderBy("rank").collect()] == [(1, 65536 * ((10**6 + 1) * (10**6 + 3) + 3)), (2, 65536 * ((10**6 + 1) * (10**6 - 1) + 21))]
    with pytest.raises(Exception, match="doesn't fit a long"):
        topk.search_block(np.array([1]), np.array([[2.0**40]]), np.array([50]), np.array([[2.0**40]]), 1)


def test_chat_windows_keep_the_budget():
    rng = random.Random(2)
    rows = [(1, "system", "a b c")] + [(1, rng.choice(["user", "assistant"]), "w " * rng.choice([0, 3, 9, 80])) for _ in range(400)]
    size = lambda text: len(text.split()) + 1
    for budget, history, room in ((50, 4, 20), (50, 0, 0), (20, 3, 100), (1, 2, 5)):
        said = []
        for _, _, text, loss, repeated in chat.windows_of(rows, budget, history, room):
            turns = chat.read_turns(text)
            own = turns[repeated:]
            said += [(r, t) for r, t, *_ in own]
            total = sum(size(t) for _, t, *_ in turns)
            assert total <= budget or len(own) == 1 and repeated <= 1
            assert turns[0][:2] == ("system", "a b c") and repeated <= history + 1
            assert len(loss) == sum(r == "assistant" for r, *_ in own)
        assert said == [(r, t) for _, r, t in rows]
