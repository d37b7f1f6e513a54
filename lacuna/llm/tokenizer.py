"""Problem 8: byte-level BPE of a public vocabulary over the whole corpus.

Texts are split by the vocabulary's pattern; the distinct new words of a batch
are merged together: the symbols of all words lie in one flat array, each round
looks up all neighbouring pairs at once by binary search over the sorted pair
keys, and each word merges its lowest-ranked pair.  Words already seen by the
task come from a bounded memo, so a corpus costs little more than its splitting.

The vocabulary file's path is a parameter; its arrays (about 50,000 entries,
whatever the corpus) are broadcast, so executors need not hold the file.

Defined results: null and empty texts have no ids (an empty list); strings of
special tokens in a text are ordinary text; texts of any length are encoded
whole, in chunks of bounded total size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lacuna.session import spread

_NO_RANK = np.int64(1) << 40
_CHUNK_CHARS = 2_000_000
_MEMO_WORDS = 200_000


@dataclass(frozen=True)
class Vocabulary:
    """Arrays of a rank file: ids of single bytes, sorted pair keys with the id each pair merges to, and the splitting pattern."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ids: np.ndarray
    plain: np.ndarray  # ids whose further merges never rank below them, so that all their occurrences may merge at once
    pattern: str


def default_vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    ranks: dict[bytes, int] = {}
    for line in Path(path or default_vocabulary_path()).read_bytes().splitlines():
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    keys, ids = [], []
    plain = np.ones(max(ranks.values()) + 1, dtype=bool)
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                ids.append(rank)
                if rank < left:
                    plain[left] = False
                if rank < right:
                    plain[right] = False
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
    return Vocabulary(byte_ids, np.array(keys, dtype=np.int64)[order], np.array(ids, dtype=np.int64)[order], plain, pattern or default_pattern())


def merge_words(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and the number of ids of each word."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    done_symbols, done_owner = [], []
    keys, merged = vocabulary.pair_keys, vocabulary.pair_ids
    while len(symbols):
        joint = np.flatnonzero(owner[:-1] == owner[1:])
        rank = np.full(len(symbols), _NO_RANK)
        if len(joint) and len(keys):
            pair = symbols[joint] << 32 | symbols[joint + 1]
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            rank[joint] = np.where(keys[at] == pair, merged[at], _NO_RANK)
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        lengths = np.diff(np.append(starts, len(symbols)))
        lowest = np.minimum.reduceat(rank, starts)
        open_word = np.repeat(lowest < _NO_RANK, lengths)
        if not open_word.all():  # finished words leave the arrays
            done_symbols.append(symbols[~open_word])
            done_owner.append(owner[~open_word])
            symbols, owner, rank = symbols[open_word], owner[open_word], rank[open_word]
            keep = lowest < _NO_RANK
            lowest, lengths = lowest[keep], lengths[keep]
            if not len(symbols):
                break
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        hit = np.flatnonzero(rank == np.repeat(lowest, lengths))
        word = np.searchsorted(starts, hit, side="right") - 1
        first = np.concatenate(([True], word[1:] != word[:-1]))
        # a run of touching hits (aaaa) merges its 1st, 3rd, 5th, ...
        run_start = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (word[1:] != word[:-1])))
        place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run_start, np.arange(len(hit)), 0))
        take = hit[first | (vocabulary.plain[lowest[word]] & (place % 2 == 0))]
        symbols[take] = rank[take]
        keep = np.ones(len(symbols), dtype=bool)
        keep[take + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    if not done_owner:
        return np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    all_symbols, all_owner = np.concatenate(done_symbols), np.concatenate(done_owner)
    order = np.argsort(all_owner, kind="stable")
    return all_symbols[order], np.bincount(all_owner, minlength=len(words))


class Encoder:
    """Encodes lists of texts; keeps the ids of words it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self._vocabulary = vocabulary
        self._split = regex.compile(vocabulary.pattern).findall
        self._reset()

    def _reset(self) -> None:
        self._index: dict[str, int] = {}
        self._ids = np.zeros(0, dtype=np.int32)
        self._starts = np.zeros(0, dtype=np.int64)
        self._counts = np.zeros(0, dtype=np.int64)

    def _learn(self, new: list[str]) -> None:
        ids, counts = merge_words([w.encode("utf-8") for w in new], self._vocabulary)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1])) + len(self._ids)
        self._ids = np.concatenate((self._ids, ids.astype(np.int32)))
        self._starts = np.concatenate((self._starts, starts))
        self._counts = np.concatenate((self._counts, counts))

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._index) > _MEMO_WORDS:
            self._reset()
        index, places, sizes, new = self._index, [], [], []
        for text in texts:
            words = self._split(text) if text else []
            sizes.append(len(words))
            for w in words:
                i = index.get(w)
                if i is None:
                    i = index[w] = len(index)
                    new.append(w)
                places.append(i)
        if new:
            self._learn(new)
        return np.array(places, dtype=np.int64), np.array(sizes, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and offsets: text i has ids[offsets[i]:offsets[i + 1]]."""
        places, sizes = self._words(texts)
        counts = self._counts[places] if len(places) else np.zeros(0, dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = self._ids[np.repeat(self._starts[places] - ends[:-1], counts) + np.arange(ends[-1])] if len(places) else np.zeros(0, dtype=np.int32)
        return ids, ends[np.concatenate(([0], np.cumsum(sizes)))]

    def count(self, texts: list[str | None]) -> np.ndarray:
        places, sizes = self._words(texts)
        sums = np.concatenate(([0], np.cumsum(self._counts[places]) if len(places) else []))
        edges = np.concatenate(([0], np.cumsum(sizes)))
        return (sums[edges[1:]] - sums[edges[:-1]]).astype(np.int64)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with bounded text (at least one row each)."""
    texts = batch.column(batch.schema.get_field_index("text"))
    start, size = 0, 0
    lengths = [0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()]
    for i, n in enumerate(lengths):
        if i > start and size + n > _CHUNK_CHARS:
            part = batch.slice(start, i - start)
            yield part, texts.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start), texts.slice(start).to_pylist()




def encode_documents(documents: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id and ids (list of integers) of every document."""
    import pyarrow.compute  # noqa: F401

    shared = documents.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        encoder = Encoder(shared.value)
        for batch in batches:
            for part, texts in _chunks(batch):
                ids, offsets = encoder.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(work, "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, columns: list[str], vocabulary_path: str | None = None) -> DataFrame:
    """``columns`` of the documents with ``tokens``, the number of ids of the text."""
    shared = documents.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    kept = documents.select(*columns, "text")
    schema = kept.drop("text").schema.add("tokens", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        encoder = Encoder(shared.value)
        for batch in batches:
            for part, texts in _chunks(batch):
                tokens = pa.array(encoder.count(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], tokens], names=[*columns, "tokens"])

    return spread(kept).mapInArrow(work, schema)
