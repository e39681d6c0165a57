"""Unigram segmentation over the pieces of a SentencePiece model file: token counts, ids and texts.

A text is marked as SentencePiece does it: a mark before it, and blanks become marks. No
piece of the vocabulary goes on past a mark that follows another character, so each marked
word (a run of marks and the characters up to the next one) is segmented by itself and
equal words once for each task's batch. Scores are those of pieces by rank, -ln(rank + 1),
since the file holds ranks. Ties go, as in the tokenizers library, to the earlier start of
the last piece. A character without a piece is unknown, scores ten less than the least
piece, and becomes its bytes.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

MARK = "▁"
_WORDS = re.compile(" +[^ ]*")
#: Distinct words that a task remembers; beyond, it starts anew.
REMEMBERED = 300_000
_vocabularies: dict = {}


class Vocabulary:
    """Pieces with ids and scores, and ids of single bytes, of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.names: list[str] = []
        self.bytes = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            self.names.append(name)
            if model.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
                self.byte_of[i] = int(name[3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[name] = (i, -math.log(i + 1))
        if any(MARK in x.lstrip(MARK) for x in self.pieces):
            raise ValueError("a piece goes on past a mark")
        self.singles = {x for x in self.pieces if len(x) == 1}
        self.unknown = min(x[1] for x in self.pieces.values()) - 10.0


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at a path; read once for each process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def words_of(text: str | None) -> list[str]:
    """The marked words of a text, with blanks in place of marks."""
    return _WORDS.findall(" " + text.replace(MARK, " ")) if text else []


class Known:
    """What a task remembers of the words it met, computed once a batch for all new words."""

    def __init__(self, compute):
        self.compute, self.of = compute, {}

    def learn(self, found: list[list[str]]) -> dict:
        every = set().union(*found)
        new = every.difference(self.of)
        if len(self.of) + len(new) > REMEMBERED:
            self.of.clear()
            new = every
        self.of.update(self.compute(new))
        return self.of


class Counter:
    """Number of tokens of a marked word: matches by Aho-Corasick, then best score and count."""

    def __init__(self, vocab: Vocabulary):
        import ahocorasick

        self.vocab = vocab
        self.machine = ahocorasick.Automaton()
        for piece, (_, score) in vocab.pieces.items():
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()

    def __call__(self, word: str) -> int:
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        known = self.vocab.singles.issuperset(word)
        done = 0  # positions up to here are final
        reached = [False] * (n + 1)
        reached[0] = True
        for last, (size, score) in self.machine.iter(word):  # at one end, longer pieces come first
            end = last + 1
            if not known and done < last:
                self._unknown(word, done, last, best, count, reached)
                done = last
            score += best[end - size]
            if not reached[end] or score > best[end]:
                best[end], count[end], reached[end] = score, count[end - size] + 1, True
        if not known:
            self._unknown(word, done, n, best, count, reached)
        return count[n]

    def _unknown(self, word: str, done: int, to: int, best: list, count: list, reached: list) -> None:
        for end in range(done + 1, to + 1):
            if word[end - 1] not in self.vocab.singles:
                score = best[end - 1] + self.vocab.unknown
                if not reached[end] or score > best[end]:
                    best[end], count[end], reached[end] = score, count[end - 1] + len(word[end - 1].encode()), True


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary(path))
        known = Known(lambda words: {w: count(w.replace(" ", MARK)) for w in words})
        for batch in C.slices(batches):
            found = [words_of(text) for text in batch.column(1).to_pylist()]
            of = known.learn(found)
            tokens = [sum(map(of.__getitem__, words)) for words in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, found)), pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """One row for each row of docs: doc_id, n_words (marked words), n_tokens.

    docs needs doc_id and text; `model` is the path of a SentencePiece model file that every
    executor has. Null or empty text: no tokens. Null doc_ids and repeated rows are rows like
    others. Empty table: no rows. Other columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(_count(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_tokens bigint")


class TrieEncoder:
    """Ids of distinct words, walked in order as the branches of a trie: forward scores of a prefix that words share are kept.

    The pieces that end at a place are found by a walk back through a trie of reversed pieces.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.back: dict = {}
        for piece, hit in vocab.pieces.items():
            node = self.back
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = hit

    def __call__(self, words) -> Iterator[tuple[str, list[int]]]:
        v, root, singles = self.vocab, self.back, self.vocab.singles
        best, back = [0.0], [(0, 0)]  # score and (start, id or -1) of the best way to each place of the path
        before = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word, strict=False):  # depth in the trie of the branch from the last word
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, way, node = -math.inf, (0, 0), root
                for start in range(end - 1, -1, -1):
                    node = node.get(word[start])
                    if node is None:
                        break
                    hit = node.get("")
                    if hit is not None:
                        score = best[start] + hit[1]
                        if score >= top:  # a tie goes to the earlier start
                            top, way = score, (start, hit[0])
                if word[end - 1] not in singles:
                    score = best[end - 1] + v.unknown
                    if score > top:
                        top, way = score, (end - 1, -1)
                best.append(top)
                back.append(way)
            ids: list[int] = []
            end = len(word)
            while end:
                start, i = back[end]
                ids.extend([i] if i >= 0 else [v.bytes[b] for b in reversed(word[start:end].encode())])
                end = start
            ids.reverse()
            yield word, ids
            before = word

    def encode(self, words: set[str]) -> dict[str, bytes]:
        """The ids, as little-endian 32-bit numbers, of words with blanks in place of marks."""
        return {word.replace(MARK, " "): np.array(ids, dtype="<u4").tobytes() for word, ids in self(w.replace(" ", MARK) for w in words)}


class Decoder:
    """Texts of ids: marks become blanks, the first one goes, runs of byte ids are UTF-8."""

    def __init__(self, vocab: Vocabulary):
        self.table = [bytes([vocab.byte_of[i]]) if i in vocab.byte_of else name.replace(MARK, " ").encode() for i, name in enumerate(vocab.names)]

    def pieces(self, ids: bytes) -> bytes:
        return b"".join([self.table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])

    def text(self, pieces: bytes) -> str:
        text = pieces.decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(TrieEncoder(vocabulary(path)).encode)
        for batch in C.slices(batches):
            found = [words_of(text) for text in batch.column(1).to_pylist()]
            of = known.learn(found)
            ids = [b"".join(map(of.__getitem__, words)) for words in found]
            bounds = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), flat), batch.column(1)], names=["doc_id", "ids", "text"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary(path))
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            texts = [decoder.text(decoder.pieces(row.values.to_numpy().astype("<u4").tobytes())) if row.is_valid else "" for row in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """One row for each row of docs: doc_id, ids (array of int), text.

    Null or empty text: no ids. Null doc_ids and repeated rows are rows like others. Empty
    table: no rows. Other columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(_encode(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def decode_ids(coded: DataFrame, model: str) -> DataFrame:
    """All columns of coded and decoded, the text of its ids; null ids: an empty text.

    The result equals the text that was encoded, except that a mark character in it becomes a
    blank. Ids outside the vocabulary fail.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(_decode(model), f"{schema}, decoded string")


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder, decoder = TrieEncoder(vocab), Decoder(vocab)
        known = Known(lambda words: {w: (ids, decoder.pieces(ids)) for w, ids in encoder.encode(words).items()})
        for batch in C.slices(batches):
            rows = []
            texts = batch.column(1).to_pylist()
            found = [words_of(text) for text in texts]
            of = known.learn(found)
            for text, words in zip(texts, found, strict=True):
                parts = list(map(of.__getitem__, words))
                ids = b"".join([x[0] for x in parts])
                back = decoder.text(b"".join([x[1] for x in parts]))
                rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return run


def encoded_digests(docs: DataFrame, model: str) -> DataFrame:
    """Encode, decode, and compare in one pass: doc_id, n_ids, ids_crc32, decoded_sha256, round_trip.

    The rows of decode_ids(encode_texts(docs)), without shipping ids and texts between the steps.
    """
    return docs.select("doc_id", "text").mapInArrow(_digest(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean")
