"""Runs of periodic words by suffix arrays, as in the branching-tandem test on LCP intervals.

The suffixes of each text are sorted by its words (prefix doubling). Suffixes that share
their first ``d`` words form an interval of the array; a square of period ``d`` that the
next word breaks shows as two suffixes ``d`` apart in different children of one interval of
depth ``d``. Each interval tests the suffixes of all its children but the largest: whether
the suffix ``d`` words on or back lies in the interval, too, which the inverse array tells.
Squares are rotated to the left as far as the words agree, and those of the same stretch
are one run. All texts of a batch are worked on side by side; the intervals are ranges of
the array, and no tree is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import body, slices, table
from reviewloom.llm.words import cut_words

SHORTEST = 12
BATCH_BYTES = 1 << 23


class SuffixArray:
    """Suffixes of many word sequences; ``text`` numbers the sequence of each word, in ascending order.

    ``ranks[k]`` names the stretch of ``2**k`` words that starts at each place: places have
    the same name where the stretches are equal and lie in the same sequence. The memory is
    four bytes for each word and level; levels grow with the logarithm of the longest repeat.
    """

    def __init__(self, codes: np.ndarray, text: np.ndarray):
        n = len(codes)
        self.text = text
        lasts = np.flatnonzero(np.append(text[1:] != text[:-1], True)) if n else np.zeros(0, dtype=np.int64)
        firsts = np.append(0, lasts[:-1] + 1)[: len(lasts)]
        sizes = lasts - firsts + 1
        self.start, self.end = np.repeat(firsts, sizes), np.repeat(lasts + 1, sizes)
        self.ranks: list[np.ndarray] = []
        rank = np.zeros(n + 1, dtype=np.int32)
        rank[n] = -1
        places = np.arange(n)
        key = text * (int(codes.max(initial=0)) + 1) + codes
        step = 1
        while len(places):
            order = np.argsort(key, kind="stable")
            places, key = places[order], key[order]
            old = rank[places]
            index = np.arange(len(places))
            opens = np.append(True, old[1:] != old[:-1])  # groups that were equal so far
            slot = old + index - np.maximum.accumulate(np.where(opens, index, 0))
            split = np.append(True, key[1:] != key[:-1])
            new = slot[np.maximum.accumulate(np.where(split, index, 0))]
            rank = rank.copy()
            rank[places] = new
            self.ranks.append(rank)
            alone = split & np.append(split[1:], True)
            places = places[~alone]
            behind = np.minimum(places + step, n)
            second = np.where(places + step < self.end[places], rank[behind] + 1, 0)
            key = rank[places].astype(np.int64) * (n + 1) + second
            step *= 2
        self.order = np.zeros(n, dtype=np.int64)
        self.order[rank[:n]] = np.arange(n)
        self.place = rank  # inverse of the order, -1 behind the end

    def common(self) -> np.ndarray:
        """Words that each suffix shares with the one before it in the order; -1 at both ends."""
        n = len(self.order)
        out = np.zeros(n + 1, dtype=np.int64)
        left, right = self.order[:-1], self.order[1:]
        alike = [np.arange(len(left))]  # pairs that share 2**k words at least
        for rank in self.ranks:
            at = alike[-1]
            alike.append(at[rank[left[at]] == rank[right[at]]])
        length = np.zeros(len(left), dtype=np.int64)
        for k in reversed(range(len(self.ranks))):
            at, rank = alike[k + 1], self.ranks[k]
            same = rank[left[at] + length[at]] == rank[right[at] + length[at]]
            length[at[same]] += 1 << k
        out[1:n] = length
        out[0] = out[n] = -1
        return out

    def back(self, place: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How many words before ``place`` equal those ``period`` words on."""
        length = np.zeros(len(place), dtype=np.int64)
        for k in reversed(range(len(self.ranks))):
            at = place - length - (1 << k)
            same = at >= self.start[place]
            rank = self.ranks[k]
            same[same] = rank[at[same]] == rank[at[same] + period[same]]
            length[same] += 1 << k
        return length


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """Nearest place to the left of each positive value that holds a smaller one."""
    found = np.arange(len(values)) - 1
    open_places = np.flatnonzero(values > 0)
    while len(open_places):
        open_places = open_places[values[found[open_places]] >= values[open_places]]
        found[open_places] = found[found[open_places]]
    return found


def _children(common: np.ndarray) -> tuple[np.ndarray, ...]:
    """(depth, low, high, first, last) of every child but the largest of each LCP interval, bounds inclusive."""
    splits = np.flatnonzero(common > 0)
    low = _smaller_before(common)[splits]
    mirrored = common[::-1]
    high = len(common) - 1 - _smaller_before(mirrored)[::-1][splits] - 1
    depth = common[splits]
    by = np.argsort(low * (int(depth.max(initial=0)) + 1) + depth, kind="stable")
    splits, low, high, depth = splits[by], low[by], high[by], depth[by]
    fresh = np.append(True, (low[1:] != low[:-1]) | (depth[1:] != depth[:-1]))[: len(splits)]
    group = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(splits))[: len(heads)] - 1
    # one child before each split and one behind the last
    total = len(splits) + len(heads)
    owner, first, last = (np.zeros(total, dtype=np.int64) for _ in range(3))
    spot = np.arange(len(splits)) + group
    owner[spot], last[spot] = group, splits - 1
    first[spot] = np.where(fresh, low, np.append(0, splits[:-1])[: len(splits)])
    spot = tails + np.arange(len(heads)) + 1
    owner[spot], first[spot], last[spot] = np.arange(len(heads)), splits[tails], high[tails]
    size = last - first
    if total:
        most = np.maximum.reduceat(size, heads + np.arange(len(heads)))
        full = np.flatnonzero(size == most[owner])
        largest = full[np.append(True, owner[full][1:] != owner[full][:-1])]
        rest = np.ones(total, dtype=bool)
        rest[largest] = False
        owner, first, last = owner[rest], first[rest], last[rest]
    of = heads[owner]
    return depth[of], low[of], high[of], first, last


def find_runs(codes: np.ndarray, text: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, ...]:
    """(place of the first word, length, period) of all runs of at least ``shortest`` words and two periods.

    ``text`` numbers the sequence that each word of ``codes`` belongs to, in ascending
    order. Runs come by place, then period; the period is the smallest of the stretch.
    """
    suffixes = SuffixArray(codes, text)
    depth, low, high, first, last = _children(suffixes.common())
    size = last - first + 1
    which = np.repeat(np.arange(len(size)), size)
    slot = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    place = suffixes.order[slot]
    squares, periods = [], []
    for onward in (True, False):
        other = place + depth[which] * (1 if onward else -1)
        near = other < suffixes.end[place] if onward else other >= suffixes.start[place]
        spot = np.where(near, suffixes.place[np.where(near, other, 0)], -1)
        near &= (spot >= low[which]) & (spot <= high[which]) & ((spot < first[which]) | (spot > last[which]))
        squares.append((place if onward else other)[near])
        periods.append(depth[which][near])
    start, period = np.concatenate(squares), np.concatenate(periods)
    longer = suffixes.back(start, period)
    start, length = start - longer, longer + 2 * period
    kept = length >= shortest
    start, length, period = start[kept], length[kept], period[kept]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[new], length[new], period[new]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def mark_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: all runs of each text and the text with each run cut to one period.

    Words are stretches without ASCII white space, counted from 0. ``runs`` are structs
    ``start, length, period`` by start, then period. ``collapsed`` has the words that no run
    contains after its first period, joined by one space.

    NULL and empty texts, and texts of white space, have no runs and an empty ``collapsed``;
    repeated rows, and NULL or repeated ids, are texts of their own; runs that share words are
    all listed, and a stretch counts once, with its smallest period; other columns are not
    read; an empty table gives no rows. Rows are not moved. A text is worked on as a whole, in
    memory of its words times the logarithm of its longest repeat.
    """
    shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, rows=1 << 14, size=BATCH_BYTES):
                cut = cut_words(part.column(1))
                counts = np.bincount(cut.text, minlength=part.num_rows)
                before = np.cumsum(counts) - counts
                start, length, period = find_runs(cut.codes, cut.text, shortest)
                owner = cut.text[start]
                change = np.bincount(start + period, minlength=len(cut.codes) + 1)
                change = change - np.bincount(start + length, minlength=len(cut.codes) + 1)
                kept = np.cumsum(change)[:-1] == 0
                runs = pa.StructArray.from_arrays(
                    [pa.array(start - before[owner]), pa.array(length), pa.array(period)], fields=list(shape)
                )
                n_runs = np.bincount(owner, minlength=part.num_rows)
                n_kept = np.bincount(cut.text[kept], minlength=part.num_rows)
                words = cut.words.filter(pa.array(kept)).cast(pa.string())
                bounds = (pa.array(np.append(0, np.cumsum(n)).astype(np.int32)) for n in (n_runs, n_kept))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(counts),
                        pa.ListArray.from_arrays(next(bounds), runs),
                        pc.binary_join(pa.ListArray.from_arrays(next(bounds), words), " "),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    chosen = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    runs = "array<struct<start: long, length: long, period: long>>"
    return chosen.mapInArrow(mark, f"doc_id {kind}, n_words long, runs {runs}, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where one text in ten, picked by a checksum of its id, repeats a part of itself to its end."""
    digest = F.crc32(F.col("doc_id").cast("string"))
    split = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda word: word != "")
    chosen = docs.select("doc_id", "text", F.floor(digest / 10).alias("g"), F.when(digest % 10 == 0, split).alias("words"))
    n = F.size("words")
    placed = chosen.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn(
        "p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))
    )
    a, p = F.col("a"), F.col("p")

    def word(own: Column, i: Column) -> Column:
        return F.when(i < a, own).otherwise(F.get("words", (a + (i - a) % p).cast("int")))

    return placed.select("doc_id", F.when(n > 0, F.array_join(F.transform("words", word), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark_runs(with_repeats(table(spark, sf_dir, "documents")))
    keys = F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    longest = found.select("*", F.array_max(keys).alias("top"))
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
