"""Importance resampling towards a target: hashed counts of word runs, log-ratio gains, a seeded draw.

Texts are split by the tokenizers library's untrained pre-tokenizer `Split`; its offsets mark the
words, and pairs of offsets the runs of words. Each run falls into a bucket by its CRC. The buckets
of a document are written once, two bytes each, and both the counts of the corpus and the scores
come from that table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, placed

#: Words: no ASCII but digits and small letters.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of a text that are split at a time, and features whose bucket a task remembers.
BLOCK, MEMORY = 1 << 18, 1 << 20


def word_splitter():
    """A function from a text to its words with their offsets."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(WORDS), behavior="removed", invert=True).pre_tokenize_str


def blocks(text: str, most: int) -> Iterator[str]:
    """A text in parts that end at the first separator after `most` characters; together they hold the same words."""
    gap, at = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"), 0
    while at < len(text):
        found = gap.search(text, at + most)
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def features(docs: DataFrame, longest: int, buckets: int, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words and cells: the bucket of each run of 1 to `longest` words, as unsigned integers side by side."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = word_splitter(), {}

        def bucket(feature: str) -> int:
            if len(known) >= MEMORY:
                known.clear()
            known[feature] = cell = zlib.crc32(feature.encode()) % buckets
            return cell

        for batch in batches:
            counts, cells = [], []
            for text in batch.column(1).to_pylist():
                n, out, held = 0, [], []
                for part in blocks(text.encode().lower().decode(), block) if text else ():  # bytes.lower changes A-Z only
                    spans = split(part)
                    n += len(spans)
                    words = held + [w for w, _ in spans]
                    for k in range(1, longest + 1):  # runs that end in this part
                        first = max(len(held) - k + 1, 0)
                        runs = words[first:] if k == 1 else [" ".join(words[i : i + k]) for i in range(first, len(words) - k + 1)]
                        out.append(np.array([known[f] if f in known else bucket(f) for f in runs], dtype=kind))
                    held = words[len(words) - longest + 1 :] if longest > 1 else []
                counts.append(n)
                cells.append(b"".join(c.tobytes() for c in out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(cells, pa.binary())], names=["doc_id", "n_words", "cells"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, cells binary")


def histogram(cells: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket; only sums of `buckets` rows leave a task."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), dtype=kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = cells.select("cells").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to raw frequency of each bucket, one added to each count; floors go down."""
    buckets, total, wanted = len(raw), float(raw.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (total + buckets) / ((s + 1.0) * (wanted + buckets))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(raw, target, strict=True)], dtype=np.int64)


def weighted(cells: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean of the gains of a document's features."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, weight = [], []
            for value in batch.column(2):
                own = np.frombuffer(value.as_buffer(), dtype=kind)
                number.append(len(own))
                weight.append(int(gain[own].sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return cells.select("doc_id", "n_words", "cells").mapInArrow(run, f"doc_id {cells.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024) -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score and rank (null: not drawn).

    docs needs doc_id and text, target a text. score is the weight plus a Gumbel number from a hash
    of seed and doc_id, so that drawing the highest scores draws without replacement in proportion to
    exp(weight / 1000). Of the N rows with at least `least` words the floor(percent * N / 100) with the highest
    scores are drawn; ties go to the smaller doc_id, null last.

    Null, empty or wordless text: no features, weight 0, never drawn. A null doc_id is hashed as an
    empty one. Rows that agree in doc_id and text have one score and consecutive ranks. An empty target
    only makes rare buckets gain. Other columns are not read. To the driver come two counts of
    `buckets` rows and one number.
    """
    s = Scratch(docs.sparkSession, "resampling")
    cells = s.save(features(docs, longest, buckets))
    wanted = s.save(features(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets))
    gain = gains(histogram(cells, buckets), histogram(wanted, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = s.save(weighted(cells, gain).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(share)))))
    s.drop(cells, wanted)
    enough = F.col("n_words") >= least
    drawn = scored.where(enough).count() * percent // 100
    order = placed(scored.where(enough), [F.desc("score"), F.asc_nulls_last("doc_id")], s)
    ranked = order.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("bigint")).select(*columns))


#: CRC-32 of distinct strings w by its linearity: each byte adds a term that depends on its distance from the end.
CRC_SQL = """
byte0 as (select b, list_reduce(list_prepend(b, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as t from (select unnest(range(256)) as b)),
most as (select coalesce(max(strlen(w)), 0) as top from strings),
byte as (with recursive r as (select 0 as dist, b, t from byte0 union all
  select r.dist + 1, r.b, xor(r.t >> 8, byte0.t) from r join byte0 on byte0.b = r.t & 255 where r.dist + 1 < (select top from most)) select * from r),
zero as (with recursive z as (select 0 as len, 4294967295 as t union all
  select z.len + 1, xor(z.t >> 8, byte0.t) from z join byte0 on byte0.b = z.t & 255 where z.len < (select top from most)) select * from z),
bytes as (select w, strlen(w) as len, unnest(range(strlen(w))) as i, hex(encode(w)) as hx from strings),
codes as (select w, len, len - 1 - i as dist, (instr('0123456789ABCDEF', hx[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', hx[2 * i + 2]) - 1 as b from bytes),
crc as (select w, xor(xor(bit_xor(byte.t), any_value(zero.t)), 4294967295) as crc from codes join byte using (dist, b) join zero using (len) group by w)
"""

SQL = rf"""
with low as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
words as (select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from low),
target as (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
f as (select rid, unnest(ws) as w from words),
strings as (select distinct w from (select w from f union all select w from target)),
{CRC_SQL},
fb as (select rid, crc % 10000 as bucket from f join crc using (w)),
raw as (select bucket, count(*) as s from fb group by bucket), tgt as (select crc % 10000 as bucket, count(*) as t from target join crc using (w) group by 1),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from f) + 10000) / ((s + 1)::double * ((select count(*) from target) + 10000))))::bigint as gain from raw left join tgt using (bucket)),
w as (select rid, floor(sum(gain)::bigint / count(*))::bigint as weight from fb join g using (bucket) group by rid),
d as (select doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h from words left join w using (rid)),
s as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296::double)))::bigint as score from d),
r as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place from s)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= (select 10 * count(*) // 100 from s where n_features >= 20) then place end as rank from r
"""
