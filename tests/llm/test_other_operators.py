"""Vectors, languages and conversations against brute force, with awkward cases."""

import collections

import numpy as np

from evidence.llm import common as C
from evidence.llm import forest, langid, quotes
from tests.sqlcheck import differences


def brute_links(rows, cosine=0.98):
    """Links and components of (row number, vec_id, vector, label)."""
    links, up = collections.Counter(), {i: i for _, i, _, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    by = collections.defaultdict(list)
    for n, i, v, label in rows:
        if i is not None and v and label is not None and None not in v and np.all(np.isfinite(v)) and any(v):
            by[label, len(v)].append((n, i, np.array(v) / np.linalg.norm(v)))
    for group in by.values():
        x = np.stack([v for _, _, v in group])
        for a, b in np.argwhere(np.triu(x @ x.T >= cosine - 1e-12, 1)):
            links[group[a][0]] += 1
            links[group[b][0]] += 1
            p, q = find(group[a][1]), find(group[b][1])
            up[max(p, q)] = min(p, q)
    return links, {i: find(i) for i in up}


def test_forest(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(150):
        centre = rng.normal(size=24)
        for k in range(rng.integers(1, 7)):
            rows.append((1000 - len(rows), (centre + rng.normal(size=24) * 0.1 * (k > 0)).tolist(), int(c % 4)))
    rows += [(rows[0][0] + 5000, rows[0][1], rows[0][2]), (rows[1][0] + 5000, rows[1][1], 3), (9001, None, 1), (9002, [0.0] * 24, 1), (9003, [float("nan")] * 24, 1), (9004, [None] + [1.0] * 23, 1)]
    rows += [(9005, rows[0][1], None), (None, rows[0][1], 0), (9006, [1.0, 2.0], 1), (9007, [2.0, 4.0], 1), (9008, [], 1), (9009, [float("inf")] * 24, 1), rows[3]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, node int, m int")
    links, comps = brute_links([(n, *r) for n, r in enumerate(rows)])
    want = sorted(((i, links[n], None if i is None else comps[i]) for n, (i, _, _) in enumerate(rows)), key=str)
    for leaf in (1500, 64, 16):
        got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in forest.near_vectors(df, leaf=leaf).collect()), key=str)
        found, there = sum(x[1] for x in got), sum(x[1] for x in want)
        assert there > 300 and found >= 0.99 * there and found <= there
        if leaf == 1500:
            assert got == want
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in forest.near_vectors(df).collect())
    assert forest.near_vectors(df.where("vec_id < 0")).count() == 0


def test_forest_family_above_the_leaf_size(spark):
    """With the default parameters; the table splits and holds a family that does not."""
    rng = np.random.default_rng(5)
    centre, wide = rng.normal(size=24), rng.normal(size=24)
    family = [centre + rng.normal(size=24) * 0.04 for _ in range(400)]
    loose = [wide + rng.normal(size=24) * 0.15 for _ in range(300)]
    others = list(rng.normal(size=(300, 24)))
    rows = [(i, v.tolist(), int(i >= 400)) for i, v in enumerate(family + loose + others)]
    links, comps = brute_links([(n, *r) for n, r in enumerate(rows)])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in forest.near_vectors(df).collect()}
    assert all(links[i] == 399 for i in range(400))
    assert all(got[i]["n_links"] == links[i] and got[i]["component_id"] == 0 for i in range(400))
    found, there = sum(got[i]["n_links"] for i in range(400, 700)), sum(links[i] for i in range(400, 700))
    assert there > 1000 and 0.99 * there <= found <= there
    assert all(got[i]["n_links"] <= links[i] for i in got) and {i: r["component_id"] for i, r in got.items()} == comps


def test_forest_parallel_vectors_and_magnitudes(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=8)
    rows = [(i, (centre * (i + 1)).tolist(), 0) for i in range(2000)]
    rows += [(3000 + i, [float(i + 1)], 0) for i in range(100)] + [(4000, [1e200, 2e200], 0), (4001, [1e200, 2e200], 0), (4002, [1e-200, 2e-200], 0), (4003, [1.0, 2.0], 0), (4004, [5e-324, 0.0], 0), (4005, [-1.0, -2.0], 0)]
    got = {r["vec_id"]: r for r in forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i]["n_links"] == 1999 and got[i]["component_id"] == 0 for i in range(2000))
    assert all(got[3000 + i]["n_links"] == 99 and got[3000 + i]["component_id"] == 3000 for i in range(100))
    assert all(got[i]["n_links"] == 3 and got[i]["component_id"] == 4000 for i in range(4000, 4004))
    assert got[4004]["n_links"] == got[4005]["n_links"] == 0 and got[4005]["kept"]


def test_forest_query_recall(spark, tmp_path):
    """The registered query against all pairs; every label is far larger than a leaf and most links are near the limit."""
    from evidence.llm import queries

    rng = np.random.default_rng(9)
    rows = []
    for c in range(900):
        centre = rng.normal(size=64)
        for k in range(1 + c % 4):
            rows.append((len(rows), (centre + rng.normal(size=64) * 0.13 * (k > 0)).tolist(), int(c % 3)))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "embeddings.parquet")).collect()]
    links, comps = brute_links([(n, i, list(v), label) for n, (i, v, label) in enumerate(rows)])
    got = {r["vec_id"]: r for r in queries.QUERIES["op7_forest"](spark, str(tmp_path)).collect()}
    want = {rows[n][0]: k for n, k in links.items()}
    assert len(got) == len(rows) and sum(want.values()) > 1000
    assert all(r["n_links"] <= want.get(i, 0) for i, r in got.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(want.values())
    assert sum(r["component_id"] != comps[i] for i, r in got.items()) <= 0.01 * sum(1 for i in comps if comps[i] != i)


def test_languages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 20 and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_training_windows_come_from_the_whole_text():
    import pyarrow as pa

    def windows(text):
        batch = pa.RecordBatch.from_pydict({"order": [1], "lang": ["en"], "text": [text]})
        return next(langid._training_windows(10)(iter([batch]))).column(2).to_pylist()

    text = " ".join(f"w{i}" for i in range(900))
    got = windows(text)
    assert len(got) == len(set(got)) == 10 and text.encode().startswith(got[0]) and text.encode().endswith(got[-1]) and {len(w) for w in got} == {langid.TRAINED}
    assert windows("ab cd") == [b"ab cd"] and windows("") == [] and len(windows("x" * 70)) == 2


def test_labels_equal_a_plain_forward_pass():
    """One position at a time, one text at a time, with the windows' context."""
    import pyarrow as pa

    net = langid.Network(["a", "b", "c"], 4, seed=2)
    w = {k: v.astype(np.float64) for k, v in net.w.items()}

    soft = lambda x: x / (1 + np.abs(x))

    def states(e, u, x):
        h, out = np.zeros(4), []
        for c in x:
            g, a = e[c], h @ u
            z, r = 0.5 + 0.5 * soft(g[:4] + a[:4]), 0.5 + 0.5 * soft(g[4:8] + a[4:8])
            h = (1 - z) * soft(g[8:] + r * a[8:]) + z * h
            out.append(h)
        return out

    texts = ["short one", "", "y" * 224, "z" * 448, "xy" * 240, "x" * 300 + " äöü " * 60, "日本語 text " * 40]
    raw, offsets = C.string_bytes(pa.array(texts))
    for text, got in zip(texts, net.sums(raw, offsets), strict=True):
        x, want = text.encode(), np.zeros(3)
        for at in range(0, len(x), langid.LABELLED):
            before = min(langid.WARM, at)
            window = x[at - before : at + langid.LABELLED + langid.WARM]
            ahead, behind = states(w["e1"], w["u1"], window), states(w["e2"], w["u2"], window[::-1])[::-1]
            for k in range(min(langid.LABELLED, len(x) - at)):
                s = np.concatenate([ahead[before + k], behind[before + k]]) @ w["o"] + w["b"]
                want += np.exp(s) / np.exp(s).sum()
        assert np.allclose(got, want, atol=1e-3) and abs(got.sum() - len(x)) < 1e-2


def short_texts(n, seed=6):
    import random

    r = random.Random(seed)
    words = {"en": "the cat sat on a mat and dogs ran home with their old friends".split(), "de": "und der hund lief nach hause weil die katze schlief ohne alte freunde".split()}
    return [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(3, 11)))[: r.choice((20, 40, 64, 90))], lang) for i in range(n) for lang in [("en", "de")[i % 2]]]


def test_short_texts_are_told_apart(spark):
    rows = short_texts(240)
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {i: x for i, _, x in rows}
    assert all(r["lang_pred"] == lang[r["doc_id"]] for r in got)


def test_repeated_rows_do_not_crowd_out_training(spark):
    """A language of one text a thousand times and 60 others once; the others are learned, too."""
    rows = short_texts(160)
    rows += [(7000, "1234 5678 " * 5, "de")] * 6000
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=100)
    import pyarrow as pa

    totals = net.sums(*C.string_bytes(pa.array([x for _, x, _ in rows[:160]])))
    assert np.mean([net.languages[k] == lang for k, (_, _, lang) in zip(totals.argmax(axis=1), rows, strict=False)]) > 0.95


def test_language_cases(spark):
    en, de = "the cat sat on the mat and the dog ran home", "und der hund lief nach hause weil die katze schlief"
    rows = [(i, [en, de][i % 2] * 3, ["en", "de"][i % 2], "x") for i in range(60)]
    rows += [(100, None, "en", "x"), (101, "", "en", "x"), (102, "123 ... 45", "en", "x"), (None, en, "de", "x"), (103, en, None, "x"), (104, "z" * 5000 + "日本" * 400, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == got[102]["lang_pred"] == "und" and got[100]["score"] == 0
    assert got[103]["lang_pred"] == got[None]["lang_pred"] == "en" and not got[None]["held_out"] and got[104]["lang_pred"] in ("en", "de")
    import zlib

    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert langid.identify(df.where("doc_id < 0")).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", df["lang"].substr(9, 1)).where("doc_id = 103 and lang is null")).collect()} == {"und"}


def test_gradients_match_differences():
    net = langid.Network(["a", "b"], 4, seed=3)
    x = np.random.default_rng(0).integers(97, 123, size=(5, 3))
    labels = np.array([0, 1, 0])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}

    def loss():
        p = net.label(x)
        return -np.log(p[:, np.arange(3), labels]).mean()

    p, h, k1, k2 = net.label(x, keep=True)
    d = p / 15
    d[:, np.arange(3), labels] -= 1 / 15
    d_h = d @ net.w["o"].T
    grads = dict(zip(("e1", "u1"), langid._unread(net.w["u1"], x, k1, d_h[:, :, :4]), strict=True))
    grads |= dict(zip(("e2", "u2"), langid._unread(net.w["u2"], x[::-1], k2, d_h[::-1, :, 4:]), strict=True))
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        step = 1e-2
        net.w[name][at] += step
        up = loss()
        net.w[name][at] -= 2 * step
        down = loss()
        net.w[name][at] += step
        assert abs((up - down) / (2 * step) - g[at]) < 2e-3 + 0.03 * abs(g[at]), name


def test_quotes(spark):
    import duckdb
    import pandas as pd

    rows = [
        (1, 0, "u", "Hello there\nHow are you?"), (1, 1, "a", "> hello   THERE\nFine"), (1, 2, "u", "> > Hello there\n> Fine\nGood"), (1, 3, "a", "new topic"),
        (1, 4, "u", ">new topic\n> fine\n> good\nok"), (1, 5, "u", "> not found\nbody"), (1, 4, "x", "> How are you?"), (1, 4, "x", "> How are you?"), (1, 6, "u", "> ok\n>> good\n>>> fine"),
        (2, 0, "u", None), (2, 1, "u", ""), (2, 2, "u", "> x"), (None, 1, "u", "> Hello there"), (3, None, "u", "hi"), (3, 1, "u", "> hi"), (4, 0, "u", "long " * 3000), (4, 1, "u", "> " + "long " * 3000 + "\nyes"),
    ]
    rows += [(5, k, "u", f"m{k}" + (f"\n> m{k - 1}" if k else "")) for k in range(30)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, pos int, h string")
    c = duckdb.connect()
    c.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    a, b = differences(quotes.reply_order(df), c, quotes.SQL)
    assert not a and not b, (list(a)[:3], list(b)[:3])
    chain = [r for r in quotes.reply_order(df).collect() if r["conv_id"] == 5]
    assert [r["turn"] for r in chain] == list(range(30)) and {r["thread"] for r in chain} == {0} and chain[7]["body"] == "m7" and chain[7]["reply_to"] == 6
    assert quotes.reply_order(df.where("conv_id < 0")).count() == 0


def test_quoted_passages_link_however_they_are_wrapped(spark):
    import duckdb
    import pandas as pd

    rows = [
        (1, 0, "a", "ok"), (1, 1, "b", "one two three\nfour five\n\nok"), (1, 2, "a", "> One two\n> three four\n>   five\nyes"), (1, 3, "b", ">> one two three\n>> four five\n> yes\nfine"),
        (1, 4, "a", "> ok\n\n> four five"), (1, 5, "b", "> three four\n> yes"), (1, 6, "a", "six seven eight"), (1, 7, "b", "> six\n> seven eight\n>\n> fine\n> ok"), (2, 0, "a", None), (2, 1, "b", ""), (2, 2, "b", ">\n> \n"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_linked"], r["n_levels"]) for r in quotes.reply_order(df).collect()}
    assert got == {
        (1, 0): (None, 0, 0), (1, 1): (None, 0, 0), (1, 2): (1, 3, 1), (1, 3): (2, 3, 2), (1, 4): (1, 2, 1), (1, 5): (2, 1, 1), (1, 6): (None, 0, 0), (1, 7): (6, 4, 1),
        (2, 0): (None, 0, 0), (2, 1): (None, 0, 0), (2, 2): (None, 0, 0),
    }
    c = duckdb.connect()
    c.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    a, b = differences(quotes.reply_order(df), c, quotes.SQL)
    assert not a and not b, (list(a)[:3], list(b)[:3])
