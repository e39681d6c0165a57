"""The text operators against brute force on small tables with every awkward case."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from evidence.llm import common as C
from evidence.llm import lines, linking, minhash, packing, quality, suffix, unigram
from tests.sqlcheck import connect, differences


@pytest.mark.parametrize(("cells", "rows", "least"), [(lines.BINS, lines.ROWS, lines.LEAST), (minhash.HASHES, minhash.ROWS, minhash.LEAST)])
def test_estimate_loses_far_less_than_bands(cells, rows, least):
    chance = 2.0**-linking.BITS
    p = chance + (1 - chance) * 0.8
    below = (chance + (1 - chance) * least) * cells
    lost = sum(math.comb(cells, k) * p**k * (1 - p) ** (cells - k) for k in range(cells + 1) if k < below)
    assert lost < 0.01 * (1 - p**rows) ** (cells // rows)


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty, blank, periodic and long texts, repeated rows."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeiourstln") for _ in range(r.randint(1, 7)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    bases = [[sentence(9) + "." for _ in range(7)] for _ in range(12)]
    common = sentence(40)
    out = []
    for i in range(90):
        lines_ = list(bases[r.randrange(12)])
        if i % 3 == 0:
            k = r.randrange(7)
            lines_[k] = lines_[k].replace("a", "A", 1)
        if i % 4 == 0:
            lines_.insert(r.randrange(7), sentence(r.randint(1, 6)))
        if i % 5 == 0:
            lines_.append(common)
        out.append((i, "\n".join(lines_)))
    out += [(100, None), (101, ""), (102, "  \n\t "), (103, "one two"), (104, "ONE two"), (105, "a" * 700), (106, "ab" * 400 + "\n" + "ab" * 60), (107, "é" * 130), (108, "x y z w " * 30)]
    out += [(109, sentence(4000)), (110, "日本 語 " * 40), (None, sentence(30)), (7, out[7][1]), (111, "…" + "q" * 99), (112, "tail " + "q" * 99), (113, "#*$ %&| <> a\nb\n\nb\nb")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns have names that the operators use inside."""
    df = spark.createDataFrame([(a, b, "en", f"s{(a or 0) % 3}" if a != 103 else None, len(b or ""), 1, "x", [2]) for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long, text_key int, key string, bands array<int>")
    return df.repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < -5")


def shingle_set(text, size):
    words = (text or "").encode().translate(LOWER).split()
    return {b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({b" ".join(words)} if words else set())


def components(sets, percent=80):
    """Smallest id reachable by links of enough similarity; sets: list of (id, set)."""
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if i == j or both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


@pytest.mark.parametrize("size, block", [(4, linking.SIDE), (5, 2)])
def test_minhash(rows, docs, none, size, block, monkeypatch):
    monkeypatch.setattr(linking, "SIDE", block)  # 2: nearly all buckets are compared in blocks
    want = components([(i, shingle_set(t, size)) for i, t in rows if i is not None])
    got = minhash.near_duplicates(docs, size=size).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"])
    assert sorted(r["n_shingles"] for r in got) == sorted(len(shingle_set(t, size)) for _, t in rows)
    assert len({want[i] for i in want}) < len(want)
    assert minhash.near_duplicates(none).count() == 0


def thue_morse(n):
    """Two words that every polynomial hash with an odd base modulo a power of two confuses."""
    ones = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[k] for k in ones), "".join("ba"[k] for k in ones)


def test_texts_built_to_collide_stay_apart(spark):
    a, b = thue_morse(2048)
    df = spark.createDataFrame([(1, a), (2, b), (3, a + " "), (4, f"{a}\nsome line"), (5, f"{b}\nother words")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    # as lines both have the same runs of five characters, so they are near copies; but they are not one class
    x = lines.Lines(np.frombuffer((a + b).encode(), dtype=np.uint8), np.array([0, 2048, 4096]))
    h1, h2 = x.digests(np.arange(2))
    assert h1[0] != h1[1] and h2[0] != h2[1]
    assert {r["doc_id"]: r["n_kept"] for r in lines.line_dedup(df).collect()} == {1: 1, 2: 0, 3: 0, 4: 1, 5: 1}


def test_bound_of_prints_loses_no_pair():
    r = np.random.default_rng(3)
    base = [r.integers(0, 2**63, size=60, dtype=np.uint64) for _ in range(3)]
    sets = [np.unique(np.concatenate([r.permutation(base[k % 3])[: r.integers(20, 60)], r.integers(0, 2**63, size=r.integers(0, 15), dtype=np.uint64)])) for k in range(40)] + [np.zeros(0, np.uint64)]
    at = np.cumsum([0, *map(len, sets)])
    prints = (C.mix(np.concatenate(sets)) >> np.uint64(48)).astype(np.uint16)
    i, j = np.triu_indices(41, 1)
    for percent in (30, 50, 80):
        true = np.array([100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b])) if len(sets[a]) and len(sets[b]) else True for a, b in zip(i, j)])
        kept = linking._within_reach(prints, at, i, j, percent)
        assert kept[true].all() and kept.sum() <= true.sum() + 3
    assert linking._within_reach(prints, at, i[:0], j[:0], 80).shape == (0,)


def test_string_hashes():
    """Lengths around eight bytes, zero bytes, and equal strings in different places."""
    words = [b"", b"a", b"a\0", b"\0", b"abcdefgh", b"abcdefg", b"abcdefghi", b"abcdefghj", b"a" * 300, b"abcdefgh"]
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    to = np.cumsum([len(w) for w in words])
    got = C.string_hashes(raw, to - [len(w) for w in words], to)
    assert got[4] == got[9] and len(set(got.tolist())) == len(words) - 1


def test_minhash_same_id_with_two_texts(spark):
    words = "a b c d e f g h i j k l m n o p q r s t".split()
    df = spark.createDataFrame([(5, " ".join(words)), (5, " ".join(reversed(words))), (2, " ".join(reversed(words))), (9, " ".join(words))], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect()} == {(5, 2), (2, 2), (9, 2)}


def brute_suffix(rows):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda x: -(2**63) if x[0] is None else x[0]):
        b = (t or "").encode()
        stays = bytearray(b"\1" * len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                stays[p : p + 100] = b"\0" * 100
            else:
                seen.add(w)
        rest = bytes(x for x, y in zip(b, stays, strict=True) if y)
        out[i] = (len(b), stays.count(0), sum(1 for x in bytes(stays).split(b"\1") if x), hashlib.sha256(rest).hexdigest(), rest)
    return out


@pytest.mark.parametrize("bucket", [suffix.BUCKET, 1])
def test_suffix(rows, docs, none, bucket, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET", bucket)  # 1: all buckets are sorted by Spark
    want = brute_suffix(rows)
    got = suffix.suffix_dedup(docs, carry=("lang",)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) == want[r["doc_id"]], r["doc_id"]
        assert r["lang"] == "en"
    assert suffix.suffix_dedup(none).count() == 0


def test_suffix_order():
    raw = np.random.default_rng(2).integers(0, 3, 3000).astype(np.uint8)  # zero bytes too
    raw[1500:1900] = raw[200:600]
    at = np.arange(len(raw) - 99)
    order, again = suffix.sorted_suffixes(raw, at)
    texts = [raw[p : p + 100].tobytes() for p in at]
    assert order.tolist() == sorted(range(len(at)), key=lambda k: (texts[k], k))
    assert again.tolist() == [k > 0 and texts[order[k]] == texts[order[k - 1]] for k in range(len(at))] and again.sum() >= 301


def test_suffix_cover_and_ranks():
    """Equal strings of 100 bytes have a sampled position at one distance; runs of equal content have equal keys."""
    import pyarrow as pa

    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcd é") for _ in range(n))
    shared = text(260)
    raw, offsets = C.string_bytes(pa.array([text(150) + shared + text(90), text(77) + shared, shared[:180]]))
    number, sample, content, at, n, _ = suffix.sampled_runs(raw, offsets)
    of_start, ranks = {}, collections.defaultdict(set)
    for t, s, c, a, k in zip(number.tolist(), sample.tolist(), content.tolist(), at.tolist(), n.tolist(), strict=True):
        of_start |= {int(offsets[t]) + a + x: s for x in range(k)}
        ranks[s, c].add(raw[offsets[t] + a : offsets[t] + a + k + 99].tobytes())
    samples = collections.defaultdict(set)
    for t in range(3):
        for p in range(offsets[t], offsets[t + 1] - 99):
            samples[raw[p : p + 100].tobytes()].add(of_start[p])
    assert all(len(x) == 1 for x in samples.values()) and all(len(x) == 1 for x in ranks.values())


def brute_lines(rows):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    plain = lambda x: x.translate(low).strip(" \t\n\r\v\f")
    first = {}
    for i, t in sorted(set(rows), key=lambda x: (-(2**63) if x[0] is None else x[0])):
        for k, x in enumerate((t or "").split("\n")):
            if plain(x):
                first.setdefault(plain(x), (-(2**63) if i is None else i, k))
    names = list(first)
    group = components([(n, {x[j : j + 5] for j in range(len(x) - 4)} or {x}) for n, x in enumerate(names)])
    keeper = {}
    for n, x in enumerate(names):
        keeper[group[n]] = min(keeper.get(group[n], first[x]), first[x])
    of = {x: keeper[group[n]] for n, x in enumerate(names)}
    out = {}
    for i, t in rows:
        own = -(2**63) if i is None else i
        stays = [x for k, x in enumerate((t or "").split("\n")) if not plain(x) or of[plain(x)] == (own, k)]
        out[i] = None if t is None else "\n".join(stays)
    return out


def test_lines(rows, docs, none):
    want = brute_lines(rows)
    got = lines.line_dedup(docs, carry=("source",)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["clean_text"] == want[r["doc_id"]], r["doc_id"]
    assert lines.line_dedup(none).count() == 0


def test_quality_against_sql(spark, docs, none, data):
    import duckdb

    c = duckdb.connect()
    c.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    a, b = differences(quality.quality_rules(docs), c, quality.SQL)
    assert not a and not b, (list(a)[:2], list(b)[:2])
    assert quality.quality_rules(none).count() == 0


def test_quality_removes_frequent_lines(spark):
    r = random.Random(1)
    words = ["w%d" % i for i in range(500)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, f"Cookie  banner HERE\n{text(30)}\n{text(25)}", "host") for i in range(60)] + [(100 + i, "cookie banner here\n" * 4 + f"one {i} more few words and the end", "host") for i in range(4)]
    out = {x["doc_id"]: x for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), depleted=0.5, with_text=True).collect()}
    assert all(out[i]["kept"] and out[i]["n_removed_lines"] == 1 and "Cookie" not in out[i]["clean_text"] for i in range(60))
    assert not any(out[100 + i]["kept"] for i in range(4))


def test_quality_tells_nulls_apart(spark):
    words = "one line of ten words that is here for all"
    rows = [(1, None, f"host\n{words}"), (1, f"host\n{words}", None)] + [(10 + i, None, f"host\nx{i} {words} {i}") for i in range(40)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).where("doc_id = 1").collect()
    assert sorted((r["n_words"], r["n_removed_lines"]) for r in got) == [(0, 0), (11, 1)]


def test_minhash_repeated_rows_stay_few(spark, monkeypatch):
    """200 copies of one row and 200 of its near copy: no intermediate table grows with their pairs."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words))] * 200 + [(2, " ".join([*words, "x"]))] * 200
    most, save = [], C.Scratch.save

    def counted(self, df):
        out = save(self, df)
        most.append(out.count())
        return out

    monkeypatch.setattr(C.Scratch, "save", counted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 400 and {r["component_id"] for r in got} == {1} and max(most) <= 400


def brute_tokens(text, tokenizer):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_packing(rows, docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for i, t in set(rows):
        ids = brute_tokens(t, tokenizer)
        copies = sum(1 for x in rows if x[0] == i)
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])[::copies]
        assert sum(r["length"] for r in pieces) == len(ids)
        assert all(r["length"] == 1024 for r in pieces[1:]) and len(pieces) == -(-len(ids) // 1024)
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in got) // 1024) + 1
    assert packing.pack(none, path).count() == 0


def best_fit_decreasing(counts, capacity=1024):
    """Number of bins, one piece at a time."""
    import bisect

    spaces, bins = [], 0
    for x in sorted(counts, reverse=True):
        for _ in range(counts[x]):
            at = bisect.bisect_left(spaces, x)
            if at == len(spaces):
                bins += 1
                space = capacity - x
            else:
                space = spaces.pop(at) - x
            bisect.insort(spaces, space)
    return bins


@pytest.mark.parametrize("n", [1, 40, 3000, 60_000])
@pytest.mark.parametrize("kind", ["lognormal", "uniform", "large", "few"])
def test_packing_plan(n, kind):
    rng = np.random.default_rng(n)
    draw = {"lognormal": lambda: rng.lognormal(6, 1, n), "uniform": lambda: rng.integers(1, 1025, n), "large": lambda: rng.integers(300, 560, n), "few": lambda: rng.choice([170, 260, 345, 410, 520, 700], n)}
    lengths = np.clip(draw[kind]().astype(int), 1, 1024)
    counts = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.make_plan(counts)
    a, load = plan.arrays(), np.zeros(plan.sequences, dtype=int)
    for x, k in counts.items():
        rank = np.arange(k)
        at = np.searchsorted(a["key"], (x << 44) + rank, side="right") - 1
        np.add.at(load, a["base"][at] + (rank + a["shift"][at]) // a["per"][at], x)
    assert load.max() <= 1024 and load.min() > 0 and load.sum() == lengths.sum()
    assert -(-int(lengths.sum()) // 1024) <= plan.sequences <= best_fit_decreasing(counts)
    assert len(plan.rows) < 30_000


def test_configurations_beat_best_fit():
    """Sizes that best-fit decreasing packs badly: the linear programme finds the full bins."""
    counts = {522: 1000, 262: 1000, 240: 1000, 257: 2000, 255: 2000}
    assert packing.make_plan(counts).sequences <= 2000 * 1.01 < best_fit_decreasing(counts)


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    r = random.Random(12)
    path = P.path("byte_bpe_50k.json")
    encoder, special = packing.byte_bpe(path)
    library = Tokenizer.from_file(path)
    odd = "aZ09 \n\t.,'’\u00a0\u200d\u0301é日本語\U0001f600ßİ\u2028\x00|<>endoftext"
    for _ in range(3000):
        text = "".join(r.choice(odd) for _ in range(r.randint(0, 60)))
        assert encoder.encode(text, allowed_special="all") == library.encode(text, add_special_tokens=False).ids, text


def test_special_token_text():
    encoder, special = packing.byte_bpe(P.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    text = "a<|endoftext|>b \n\n  c é 日本"
    assert special and encoder.encode(text, allowed_special="all") == Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def unigram_oracle():
    """The tokenizers library's own unigram model with the same pieces, scores and words."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    v = unigram.vocabulary(P.path("piece_bpe_32k.model"))
    full = [(x, v.pieces[x][1]) if x in v.pieces and v.pieces[x][0] == i else (x if x.startswith("<") else f"<x{i}>", -5.0) for i, x in enumerate(v.names)]
    t = Tokenizer(models.Unigram(full, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Split(Regex("▁+[^▁]*"), "isolated")
    return lambda text: t.encode(unigram.marked(text), add_special_tokens=False).ids if text else []


def test_unigram(spark, rows, docs, none, unigram_oracle):
    model = P.path("piece_bpe_32k.model")
    want = {i: unigram_oracle(t) for i, t in rows}
    assert all(r["n_tokens"] == len(want[r["doc_id"]]) for r in unigram.token_counts(docs, model).collect())
    assert all(list(r["ids"]) == want[r["doc_id"]] for r in unigram.encode_texts(docs, model).collect())
    digests = unigram.encoded_digests(docs, model).collect()
    assert len(digests) == len(rows) and all(r["round_trip"] for r in digests)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(want[r["doc_id"]], dtype="<u4").tobytes()) for r in digests)
    assert unigram.token_counts(none, model).count() == unigram.encoded_digests(none, model).count() == 0


def test_word_bounds():
    assert unigram.words_of("a  b c ") == [" a", "  b", " c", " "] and "".join(unigram.words_of(" x▁y")) == "  x y" and unigram.words_of("") == unigram.words_of(None) == []


def test_fused_digests_equal_the_steps(spark, docs):
    model = P.path("piece_bpe_32k.model")
    steps = unigram.decode_ids(unigram.encode_texts(docs, model), model).collect()
    want = sorted(((r["doc_id"], len(r["ids"]), hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in steps), key=str)
    assert sorted(((r["doc_id"], r["n_ids"], r["decoded_sha256"]) for r in unigram.encoded_digests(docs, model).collect()), key=str) == want
    assert all(r["decoded"] == (r["text"] or "") for r in steps)


@pytest.mark.parametrize("name, module", [("op1_quality", "quality"), ("op4_quotes", "quotes")])
def test_sql_queries(spark, data, name, module):
    from evidence.llm import queries

    a, b = differences(queries.QUERIES[name](spark, data), connect(data), queries.ORACLE_SQL[name])
    assert not a and not b


def test_star_of_components(spark):
    from evidence.llm.common import Scratch, connected_components

    edges = [(i + 1, i) for i in range(40)] + [(100 + k, 100) for k in range(1, 30)] + [(205, 203), (205, 201), (203, 202)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "hi long, lo long"), Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 30)} | {202: 201, 203: 201, 205: 201}
    assert connected_components(spark.createDataFrame([], "hi long, lo long"), Scratch(spark, "test")).count() == 0


def test_registered_queries(spark, rows, docs, tmp_path):
    """The queries themselves, with their parameters, over a folder of tables."""
    from evidence.llm import queries

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {n: queries.QUERIES[n](spark, str(tmp_path)) for n in ("op2_minhash", "op3_tokens", "op5_suffix", "op6_lines", "op8_pieces", "op10_packing")}
    want = components([(i, shingle_set(t, 4)) for i, t in rows if i is not None])
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got["op2_minhash"].collect())
    cut = brute_suffix(rows)
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == cut[r["doc_id"]][:4] for r in got["op5_suffix"].collect())
    clean = brute_lines(rows)
    digest = lambda x: None if x is None else hashlib.sha256(x.encode()).hexdigest()
    lines_of = got["op6_lines"].collect()
    assert len(lines_of) == len(rows) and all(r["clean_sha256"] == digest(clean[r["doc_id"]]) for r in lines_of)
    for name in ("op3_tokens", "op8_pieces"):
        assert got[name].count() == len(rows)
    packed = got["op10_packing"].collect()
    by = collections.defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024
    assert {(r["doc_id"]) for r in packed} == {i for i, _ in rows}


def test_members_are_joined_once_for_small_and_large_buckets(spark, docs, monkeypatch):
    """Each join of all members against their buckets runs once, however many kinds of buckets are compared."""
    plans, save = [], C.Scratch.save

    def noted(self, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return save(self, df)

    monkeypatch.setattr(C.Scratch, "save", noted)
    monkeypatch.setattr(linking, "SIDE", 2)
    lines.line_dedup(docs)
    assert sum(p.count("Join LeftOuter, (key#") for p in plans) == 3  # members and sizes, members and hubs, members and mixed buckets


def test_only_sets_that_share_a_bucket_go_on(spark):
    """Of all signatures those are left that later joins need, with their buckets; what only passes the filters is not."""
    r = np.random.default_rng(8)
    sig = r.integers(0, 256, size=(400, lines.BINS), dtype=np.uint8)
    for k in range(30):
        sig[200 + k, 7 * (k % 24) : 7 * (k % 24) + 7] = sig[k // 3, 7 * (k % 24) : 7 * (k % 24) + 7]
    schema = "id long, sig binary, times int"
    s = C.Scratch(spark, "test")
    reps = s.save(spark.createDataFrame([(i, bytes(x.tobytes()), i % 3) for i, x in enumerate(sig)], schema))
    met, counted = linking.meeting(reps, lines.ROWS, s)
    keys = linking.band_keys(sig, lines.ROWS).view(np.int64)
    n = collections.Counter(keys.ravel().tolist())
    want = {(i, int(k), n[int(k)]) for i in range(400) for k in keys[i] if n[int(k)] > 1}
    assert want and {(x["id"], x["key"], x["n"]) for x in counted.collect()} == want
    got = {x["id"]: (bytes(x["sig"]), x["times"]) for x in met.collect()}
    assert got == {i: (sig[i].tobytes(), i % 3) for i, _, _ in want}
    none = s.save(spark.createDataFrame([], schema))
    assert [t.count() for t in linking.meeting(none, lines.ROWS, s)] == [0, 0]


def test_sets_of_repeated_lines():
    import pyarrow as pa

    lot = [b"abcdefg", b"xyz", b"abcdefg", "çedilla ééé".encode(), b"aaaaaaaaa", b"xyz"]
    values, at = lines._gram_sets(pa.array(lot, pa.binary()))
    for k, x in enumerate(lot):
        own, _ = lines._gram_sets(pa.array([x], pa.binary()))
        assert values[at[k] : at[k + 1]].tolist() == own.tolist()
    assert np.diff(at).tolist() == [3, 1, 3, 7, 1, 1]


def test_buckets_of_the_same_members_count_once(spark):
    """Two sets that share many buckets are compared in one of them, which is the one of the least key, with the weight of all."""
    r = np.random.default_rng(9)
    sig = r.integers(0, 256, size=(60, lines.BINS), dtype=np.uint8)
    sig[41, 14:] = sig[40, 14:]  # 22 of 24 bands
    sig[42, :14] = sig[40, :14]  # the other two
    s = C.Scratch(spark, "test")
    reps = s.save(spark.createDataFrame([(i, bytes(x.tobytes())) for i, x in enumerate(sig)], "id long, sig binary"))
    _, counted = linking.meeting(reps, lines.ROWS, s)
    keys = linking.band_keys(sig, lines.ROWS).view(np.int64)
    many, two = int(keys[40, 2:].min()), int(keys[40, :2].min())
    assert {tuple(x[c] for c in ("id", "key", "n", "weight")) for x in counted.collect()} == {(40, many, 2, 22), (41, many, 2, 22), (40, two, 2, 2), (42, two, 2, 2)}
