"""The pipeline against its stages computed by brute force on a small table."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from tests.llm.test_text_operators import brute_lines, brute_suffix, components, shingle_set


def rejected(text):
    words = (text or "").encode().split()
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = collections.Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(5)}
    return len(words) < 10 or 100 * len(covered) > 20 * len(words)


def make_rows():
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeiourstln") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(40)
    rows = []
    for i in range(40):
        rows.append((i, "\n".join(text(r.randint(8, 20)) for _ in range(5))))
    for i in range(40, 60):  # copies, near copies in one long line, lines of others, shared passages
        base = rows[i - 40][1]
        kind = i % 4
        rows.append((i, base if kind == 0 else base.replace("\n", " ").replace("a", "e", 1) if kind == 1 else base + "\n" + text(12) if kind == 2 else f"{text(15)} {passage} {text(9)}"))
    return [*rows, (70, None), (71, ""), (72, "too short"), (73, "again and again we say it " * 12), (74, text(3000))]


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = make_rows()
    df = spark.createDataFrame([(i, t, "en", "host", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    rows = [(i, t) for i, t in rows if not rejected(t)]
    clean = brute_lines(rows)
    rows = [(i, clean[i]) for i, t in rows if clean[i] == t or clean[i].split()]
    group = components([(i, shingle_set(t, 5)) for i, t in rows])
    rows = [(i, t) for i, t in rows if group[i] == i]
    left = brute_suffix(rows)
    rows = [(i, left[i][4].decode(errors="ignore")) for i, t in rows if left[i][1] == 0 or left[i][4].split()]
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        first, start = len(ids) % 1024 or 1024, 0
        for piece, stop in enumerate(range(first, len(ids) + 1, 1024)):
            want[i, piece] = (start, stop - start, zlib.crc32(np.array(ids[start:stop], dtype="<u4").tobytes()))
            start = stop
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    assert 40 <= len(rows) < 58


def test_intermediate_tables_go(spark, tmp_path):
    """After a run only the last stage's input and what its result reads are in the shared folder."""
    import os

    from evidence.llm.common import shared_dir

    df = spark.createDataFrame([(i, t, "en", "host", len(t or "")) for i, t in make_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, str(tmp_path))
    new = sorted(set(os.listdir(folder)) - before)
    assert [n.split("-")[0] for n in new] == ["packing", "pipeline"]
    assert len(os.listdir(os.path.join(folder, new[1]))) == 1 and out.count() > 40


def test_stages_keep_the_columns(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "en", "host", len(t or "")) for i, t in make_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).dtypes == df.dtypes, name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
