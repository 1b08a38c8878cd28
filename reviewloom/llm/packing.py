"""Best-fit packing of documents into sequences, certified by dual feasible functions.

Documents become token pieces; only documents longer than a sequence are cut. Pieces
are dealt to partitions of bounded size and packed best-fit decreasing. A lower bound
from dual feasible functions tells which partitions use as few sequences as possible.
The others, and the emptiest sequence of each, give their documents up, which are dealt
anew and packed again.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.bpe_lexicon import Vocabulary
from reviewloom.llm.common import body, give_back, keep, slices, table
from reviewloom.llm.words import cut_words

CAPACITY = 2048
PIECES_PER_PART = 50_000
REMEMBERED = 300_000
TEXTS_AT_ONCE = 1000
BYTES_AT_ONCE = 1 << 22  # of text, unless one alone is longer: bounds what a task holds besides its words
AFTER_LATIN = "ƀ"  # letters below it are single characters that normal forms leave alone
# Words of such letters without a special token; İ is left out, as its small form is two characters
LATIN_WORD = r"^[^<\x{0130}\x{0180}-\x{10FFFF}]*$"
ENDS_CLAUSE = r"[\p{L}\p{N}][.,]$"


class WordIds:
    """Ids of texts by the tokenizers library, whose vocabulary drops white space between words.

    Such a text is the sum of what lies between its spaces. Words become numbers in one
    pass; only the different ones of a batch are looked at, without case and without a
    last point or comma, and each of those is encoded once and remembered, up to a bound.
    Words of small Latin letters are merged side by side; all others go to the library.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = Vocabulary(tokenizer_json)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = array("I"), array("q", [0])
        self._learn(["", ".", ","])

    def _add(self, word: str, ids: Sequence[int]) -> None:
        self.known[word] = len(self.starts) - 1
        self.flat.extend(ids)
        self.starts.append(len(self.flat))

    def _learn(self, new: list[str]) -> None:
        latin = [word for word in new if word.isalpha() and word.islower() and max(word) < AFTER_LATIN]
        for word, ids in zip(latin, self.vocabulary.merge_many([word.encode() for word in latin])):
            self._add(word, ids)
        new = [word for word in new if word not in self.known]
        for word, found in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False)):
            self._add(word, found.ids)

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers in ``known`` of each word and of the point or comma after it, two to a row.

        A point or comma is a word of its own after a letter or digit.
        """
        words = words.cast(pa.string())
        plain = pc.match_substring_regex(words, LATIN_WORD)
        small = pc.if_else(plain, pc.utf8_lower(words), words)
        ended = pc.and_(plain, pc.match_substring_regex(small, ENDS_CLAUSE))
        parts = pc.if_else(ended, pc.utf8_slice_codeunits(small, 0, -1), small).dictionary_encode()
        held = parts.dictionary.to_pylist()
        self._learn([part for part in held if part not in self.known])
        of_part = np.fromiter(map(self.known.__getitem__, held), dtype=np.int64, count=len(held))
        marks = np.array([self.known[mark] for mark in ("", ".", ",")])
        comma = pc.ends_with(small, ",").to_numpy(zero_copy_only=False)
        after = np.where(ended.to_numpy(zero_copy_only=False), marks[1 + comma.astype(np.int64)], marks[0])
        return np.stack([of_part[parts.indices.to_numpy()], after], axis=1)

    def encode(self, texts: Sequence[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids start and the end)."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        cut = cut_words(texts, b" \n")
        numbers = self._numbers(cut.known)
        # the lists as they lie, without a copy: they must not grow before both views are gone
        parts, ends = gather(np.frombuffer(self.flat, dtype="<u4"), np.frombuffer(self.starts, dtype=np.int64), numbers.ravel())
        ids, ends = gather(parts, ends[::2], cut.codes)
        bounds = ends[np.cumsum([0, *np.bincount(cut.text, minlength=len(texts))])]
        if len(self.known) > REMEMBERED:
            self._forget()
        return ids, bounds


def gather(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the chosen ``rows`` of lists held one after another in ``flat``, where each starts and the end)."""
    sizes = starts[rows + 1] - starts[rows]
    bounds = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum(sizes, out=bounds[1:])
    places = np.arange(bounds[-1])
    places += np.repeat(starts[rows] - bounds[:-1], sizes)
    return flat[places], bounds


def cut_documents(
    docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the ids of each whole text and a closing 0, cut where too long.

    A NULL or empty text has the closing 0 only; repeated rows repeat; an empty table
    gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        closing = np.zeros(1, dtype="<u4")
        for batch in batches:
            if encoder is None:
                give_back()  # what the stage before has left in this worker
                encoder = WordIds(shared.value)
            for part in slices(batch, 1, TEXTS_AT_ONCE, BYTES_AT_ONCE):
                ids, bounds = encoder.encode(part.column(1))
                rows, pieces, starts, lengths, sums = [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    raw = memoryview(np.concatenate([ids[a:b], closing])).cast("B")
                    for piece, at in enumerate(range(0, b - a + 1, capacity)):
                        held = min(capacity, b - a + 1 - at)
                        rows.append(i)
                        pieces.append(piece)
                        starts.append(at)
                        lengths.append(held)
                        sums.append(zlib.crc32(raw[4 * at : 4 * (at + held)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(pieces, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    chosen = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset in it, number of bins): longest first, each into the fullest bin that still takes it."""
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    bins, offsets, used = [0] * len(sizes), [0] * len(sizes), 0
    for i in order:
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            target = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, target = capacity, used
            used += 1
        bins[i], offsets[i] = target, capacity - room
        left = room - size
        open_bins[left].append(target)
        rooms |= 1 << left
    return np.array(bins, dtype=np.int64), np.array(offsets, dtype=np.int64), used


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins any packing needs, by two families of dual feasible functions.

    The first rounds items above ``capacity - a`` up to a whole bin and those below
    ``a`` down to nothing, for each ``a`` up to half a bin. The second rounds to
    multiples of one part in ``k``. The plain sum is the first one with ``a = 0``.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    items = np.concatenate([[0], np.cumsum(counts)])  # items[x]: how many are shorter than x
    volume = np.concatenate([[0], np.cumsum(counts * size)])
    a = np.arange(capacity // 2 + 1)
    whole = items[-1] - items[capacity - a + 1]
    middle = volume[capacity - a + 1] - volume[a]
    best = int((-(-(whole * capacity + middle) // capacity)).max())
    for k in range(1, 101):
        scaled = (k + 1) * size
        weight = np.where(scaled % capacity == 0, scaled * k, (scaled // capacity) * (k + 1) * capacity)
        total = int((weight * counts).sum())  # in units of one bin over k (k + 1) capacity
        best = max(best, -(-total // (k * (k + 1) * capacity)))
    return best


_PACKED = "doc_id {0}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, settled boolean, bins long, bound long"


def _pack_round(pieces: DataFrame, number: int, parts: int, capacity: int) -> DataFrame:
    """Pieces packed in ``parts`` partitions; ``settled`` ones stay, ``bins`` and ``bound`` are those of the partition."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
        settled = np.ones(used, dtype=bool) if used == bound else fill == capacity
        if fill.min() < capacity:
            settled[fill.argmin()] = False
        rows = rows[columns].copy()
        rows["sequence_id"] = ((np.int64(number) << 32 | np.int64(key[0])) << 20) + bins
        rows["offset"] = offsets
        rows["settled"] = settled[bins]
        rows["bins"] = used
        rows["bound"] = bound
        return rows

    spread = F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id(), F.lit(number)), F.lit(parts))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    dealt = pieces.select(*columns, spread.alias("part"))
    return keep(dealt.groupBy("part").applyInPandas(pack, _PACKED.format(kind)))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, per_part: int = PIECES_PER_PART) -> DataFrame:
    """``pieces`` (as ``cut_documents`` gives them) with ``sequence_id`` and ``offset``.

    Pieces as long as a sequence are one. The rest is packed in rounds, each over the
    pieces that the last one gave up, until one partition holds them all or a round
    saves nothing. Partitions are dealt by a hash of the whole row and its number, so
    repeated rows spread. The driver sees counts only.
    """
    pieces = keep(pieces)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = pieces.filter(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    done = [whole.select(*columns)]
    open_pieces = pieces.filter(F.col("length") < capacity)
    number, held = 0, None
    while count := open_pieces.count():
        parts = -(-count // per_part)
        packed = _pack_round(open_pieces, number, parts, capacity)
        if held is not None:
            saved = held[1] - packed.agg(F.count_distinct("sequence_id")).first()[0]
            if saved <= 0:
                done.append(held[0].select(*columns))
                break
        done.append(packed.filter("settled").select(*columns))
        left = packed.filter("NOT settled")
        if parts == 1:
            done.append(left.select(*columns))
            break
        held = (left, left.agg(F.count_distinct("sequence_id")).first()[0])
        open_pieces, number = left, number + 1
    return reduce(DataFrame.unionByName, done)


def word_vocabulary() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def pack_documents(docs: DataFrame, tokenizer_json: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of whole documents in few sequences."""
    return pack_pieces(cut_documents(docs, tokenizer_json or word_vocabulary(), capacity), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
