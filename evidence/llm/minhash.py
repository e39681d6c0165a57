"""Near-duplicate documents by b-bit MinHash.

A signature packs the 8 low bits of the minima of 160 hash functions; the bits of 5
neighbours are one of 32 band keys. Documents that share a band key are candidates; the
share of equal cells, counted in bits and corrected for chance collisions, discards the
hopeless ones; every link is then confirmed on the full shingle sets. At a similarity of 0.8 a pair
misses all 32 bands with a probability of 3e-6.

Equal sets collapse into one class first; `linking` says how the rest is compared without
emitting all pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .linking import BITS, link, meeting

HASHES, ROWS = 160, 5
#: Estimated similarity under which a candidate is discarded; at a similarity of 0.8 it loses far less than the bands do.
LEAST = 0.6

_PROFILE = "n_shingles bigint, h1 bigint, h2 bigint, sig binary"


def _profiles(size: int, keep: list[str]):
    """Map function: shingle count, 128-bit digest of the sorted set and signature of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            raw, offsets = C.string_bytes(batch.column(batch.schema.get_field_index("text")))
            words, bounds = C.word_hashes(raw, offsets, lower=True)
            sets, at = C.distinct_sorted(*C.shingles(words, bounds, size))
            n = np.diff(at)
            full = np.flatnonzero(n)
            rows = len(n)
            low = np.zeros((rows, HASHES), dtype=np.uint64)
            key = np.zeros((rows, 2), dtype=np.uint64)
            if len(full):
                starts = np.append(at[:-1][full], at[-1])
                low[full] = C.minima(sets, starts, HASHES, seed=7)
                key[full] = C.digests(sets.view(np.uint8), 8 * starts[:-1], 8 * starts[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep]
                + [pa.array(n), pa.array(C.as_signed(key[:, 0].copy())), pa.array(C.as_signed(key[:, 1].copy())), C.binary_rows(C.pack(low, BITS))],
                names=[*keep, "n_shingles", "h1", "h2", "sig"],
            )

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, scratch: C.Scratch | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    docs needs doc_id (integer) and text. A document's set is its distinct runs of `size`
    words (all words as one run where there are fewer), A-Z lower-cased. Two documents are
    linked when 100 * |intersection| >= percent * |union|; component_id is the smallest
    doc_id reachable by links, itself included, and kept marks that document.

    Null, empty or wordless text: empty set, no links, kept. Rows with one doc_id are one
    document that has several texts: they are linked with each other. A null doc_id: the
    row stays, with component_id null and kept true, and links nothing.
    Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    s = scratch or C.Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    prof = s.save(keyed.mapInArrow(_profiles(size, ["doc_id", "text_key"]), f"doc_id bigint, text_key bigint, {_PROFILE}"))

    # one class for each distinct set; its smallest document stands for it
    live = prof.where("n_shingles > 0 and doc_id is not null")
    classes = live.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.count(F.lit(1)).alias("m"))
    reps = s.save(live.join(classes.select("rep.*"), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("id"), "text_key", "sig"))

    # a document with several texts stands in several classes: those are linked
    several = live.groupBy("doc_id").agg(F.count_distinct("h1", "h2").alias("sets")).where("sets > 1").select("doc_id")
    own = live.join(several, "doc_id", "left_semi").join(classes, ["h1", "h2"]).where("doc_id <> rep.doc_id").select(F.col("doc_id").alias("hi"), F.col("rep.doc_id").alias("lo"))
    met, counted = meeting(reps, ROWS, s)
    s.drop(reps)
    comp = link(met, counted, s.save(_items(met, keyed, size, s)), percent, ROWS, LEAST, s, own)

    rep_of = classes.select("h1", "h2", "m", F.col("rep.doc_id").alias("rep"))
    named = s.save(rep_of.join(comp, rep_of["rep"] == comp["node"], "left").select("h1", "h2", "m", F.coalesce("component", "rep").alias("component_id")))
    linked = C.salted_join(live.select("doc_id", "n_shingles", "h1", "h2", "text_key", F.monotonically_increasing_id().alias("row")), named, ["h1", "h2"], "m", F.col("row"))
    alone = prof.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "n_shingles", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sets(size: int, bits: np.ndarray):
    """Map function: the shingle sets of the rows whose text_key passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            batch = batch.filter(pa.array(C.passes(bits, batch.column(batch.schema.get_field_index("text_key")).to_numpy().view(np.uint64))))
            raw, offsets = C.string_bytes(batch.column(batch.schema.get_field_index("text")))
            sets, at = C.distinct_sorted(*C.shingles(*C.word_hashes(raw, offsets, lower=True), size))
            doc, key = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_key"))
            yield pa.RecordBatch.from_arrays([doc, key, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(C.as_signed(sets)))], names=["doc_id", "text_key", "items"])

    return run


def _items(met: DataFrame, keyed: DataFrame, size: int, s: C.Scratch) -> DataFrame:
    """The shingle sets (id, items) of some classes, computed where their texts are."""
    at = s.save(met.select("id", "text_key"))
    sets = keyed.mapInArrow(_sets(size, C.bit_filter(at, "text_key")), "doc_id bigint, text_key bigint, items array<bigint>")
    found = sets.join(at, (sets["doc_id"] == at["id"]) & (sets["text_key"] == at["text_key"]), "left_semi")
    return found.select(F.col("doc_id").alias("id"), "items").distinct()
