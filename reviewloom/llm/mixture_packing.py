"""Packing to a mixture: deficit round-robin over one queue of documents per source.

Each source's documents form a queue of tokens. A window is one round: every queue earns
its share of the window as a quantum, is served the whole tokens of its deficit, and places
left go to the queues whose next token falls due first. What a queue was not served, or was
served early, is less than one token and is carried into the next window. After ``ROUNDS``
windows with the same shares all deficits are zero again, so the state at any window follows
from its number: partitions cut their own documents without waiting for one another.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.llm.bpe_lexicon import PATTERN, Vocabulary, default_vocabulary
from reviewloom.llm.common import body, keep, share, slices, table
from reviewloom.operators.lookup import lookup_join

CAPACITY = 1024
ROUNDS = 1024
MOST_QUEUES = 1024


class ByteIds:
    """Ids of texts for a byte-level vocabulary whose merges are numbered in the order they apply.

    Such a vocabulary is a table of ranks, which the compiled encoder takes; one whose
    ids are in another order goes to the tokenizers library.
    """

    def __init__(self, tokenizer_json: str):
        vocabulary = Vocabulary(tokenizer_json)
        self.width = np.dtype("<u2" if max(vocabulary.bytes_of) < 1 << 16 else "<u4")
        ordered = all(a < b for a, b in zip(vocabulary.merged, vocabulary.merged[1:]))
        if ordered and vocabulary.byte_ids == vocabulary.end_ids:
            import tiktoken

            special = set(vocabulary.special.values())
            ranks = {word: i for i, word in vocabulary.bytes_of.items() if i not in special}
            coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=vocabulary.special)
            self._one = lambda text: coder.encode_to_numpy(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(tokenizer_json)
            library.no_truncation()
            library.no_padding()
            self._one = lambda text: np.array(library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str, closing: int = 0) -> np.ndarray:
        """Ids of a text and a closing one."""
        return np.append(self._one(text), closing).astype(self.width)


def apportion(amount: int, weights: Sequence[int]) -> list[int]:
    """``amount`` split in proportion to whole weights, exactly; larger remainders are rounded up, then the first."""
    total = sum(weights)
    parts = [amount * w // total for w in weights]
    order = sorted(range(len(weights)), key=lambda s: (-(amount * weights[s] % total), s))
    for s in order[: amount - sum(parts)]:
        parts[s] += 1
    return parts


def served(weights: Sequence[int], rounds: int) -> np.ndarray:
    """Tokens each queue has been served after 0, 1, ... ``rounds`` windows; ``weights`` are those of all rounds.

    ``entitled`` is what a queue has earned so far, in ``rounds``-ths of a token. Its
    deficit is that less what it was served, and stays between -1 and 1: a window first
    serves all that is due, then, by due date, tokens a queue has earned in part.
    """
    weight = np.array(weights, dtype=np.int64)
    capacity = int(weight.sum()) // rounds
    out = np.zeros((rounds + 1, len(weight)), dtype=np.int64)
    never = np.iinfo(np.int64).max
    for w in range(1, rounds + 1):
        entitled = w * weight
        now = np.maximum(entitled // rounds, out[w - 1])
        spare = w * capacity - int(now.sum())
        if spare:
            early = np.flatnonzero(now * rounds < entitled)  # part of the next token is earned
            due = -(-(now[early] + 1) * rounds // np.maximum(weight[early], 1))
            now[early[np.argsort(due, kind="stable")[:spare]]] += 1
        out[w] = now
    return out


@dataclass
class Phase:
    """Windows that share their weights: ``first`` of them, how many, their size, and tokens served before.

    ``weights`` are tokens for each queue in ``rounds`` windows.
    """

    first: int
    windows: int
    rounds: int
    weights: list[int]
    before: list[int]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens served after each round, and where each queue starts in each round's window."""
        if not hasattr(self, "_tables"):
            total = served(self.weights, self.rounds)
            sizes = np.diff(total, axis=0)
            self._tables = (total, np.cumsum(sizes, axis=1) - sizes)
        return self._tables

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name != "_tables"}

    def after(self, windows: int) -> list[int]:
        cycles, rest = divmod(windows, self.rounds)
        part = self.tables()[0][rest].tolist() if rest else [0] * len(self.weights)
        return [b + cycles * w + p for b, w, p in zip(self.before, self.weights, part)]


def plan_windows(
    sizes: Sequence[int], capacity: int = CAPACITY, targets: Sequence[int] | None = None, rounds: int = ROUNDS
) -> list[Phase]:
    """Phases that empty queues of ``sizes`` tokens.

    ``targets`` are whole weights; without them, shares of what is left, so that all
    queues end together. When a queue runs dry the others go on in their proportions;
    queues of weight 0 come after all others. The last tokens fill windows that are powers
    of two, which need no padding.
    """
    phases: list[Phase] = []
    done = [0] * len(sizes)
    first = 0
    total = sum(sizes)

    def add(windows: int, every: int, weights: list[int]) -> None:
        nonlocal done, first
        phase = Phase(first, windows, every, weights, done)
        done = phase.after(windows)
        first += windows
        phases.append(phase)

    def wanted(left: list[int]) -> list[int]:
        chosen = [t if n else 0 for t, n in zip(targets, left)] if targets else left
        return chosen if any(chosen) else left

    def one(size: int) -> list[int]:
        """One window that no queue is too short for."""
        out, missing = [0] * len(sizes), size
        while missing:
            left = [n - d - o for n, d, o in zip(sizes, done, out)]
            more = [min(a, b) for a, b in zip(apportion(missing, wanted(left)), left)]
            out = [a + b for a, b in zip(out, more)]
            missing = size - sum(out)
        return out

    while windows := (total - sum(done)) // capacity:
        left = [n - d for n, d in zip(sizes, done)]
        weights = apportion(capacity * rounds, wanted(left))
        cycles = min(n // w for n, w in zip(left, weights) if w)
        enough = (cycles * np.array(weights) + served(weights, rounds) <= np.array(left)).all(axis=1)
        many = min(windows, cycles * rounds + int(enough.sum()) - 1)
        if many > 0:
            add(many, rounds, weights)
        else:
            add(1, 1, one(capacity))
    rest = total - sum(done)
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            add(1, 1, one(1 << bit))
    return phases


class Cutter:
    """Pieces of token ranges of the queues, by the phases of a plan."""

    def __init__(self, phases: list[Phase]):
        self.phases = phases
        self.before = np.array([p.before for p in phases], dtype=np.int64)
        self.after = np.array([p.after(p.windows) for p in phases], dtype=np.int64)

    def pieces(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, place in the queue, length, sequence, offset) of each piece, by row and place."""
        found: list[tuple[np.ndarray, ...]] = []
        for s in np.unique(queue).tolist():
            rows = np.flatnonzero(queue == s)
            low, high = start[rows], start[rows] + size[rows]
            first = bisect_right(self.after[:, s], int(low.min()))
            for p in range(first, len(self.phases)):
                if self.before[p, s] >= high.max():
                    break
                if self.before[p, s] < self.after[p, s]:
                    found.extend(self._of_phase(p, s, rows, low, high))
        if not found:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
        out = [np.concatenate(column) for column in zip(*found)]
        order = np.lexsort((out[1], out[0]))
        return tuple(column[order] for column in out)

    def _of_phase(self, p: int, s: int, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
        phase = self.phases[p]
        total, starts = phase.tables()
        weight, before = phase.weights[s], phase.before[s]
        here = (low < self.after[p, s]) & (high > before)
        rows, low, high = rows[here], np.maximum(low[here], before) - before, high[here] - before
        if not len(rows):
            return
        high = np.minimum(high, self.after[p, s] - before)

        def window(token: np.ndarray) -> np.ndarray:
            cycle, rest = np.divmod(token, weight)
            return cycle * phase.rounds + np.searchsorted(total[:, s], rest, side="right") - 1

        first, last = window(low), window(high - 1)
        count = last - first + 1
        at = np.repeat(np.arange(len(rows)), count)
        number = np.repeat(first, count) + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        cycle, spot = np.divmod(number, phase.rounds)
        opens = cycle * weight + total[spot, s]
        closes = cycle * weight + total[spot + 1, s]
        a, b = np.maximum(opens, low[at]), np.minimum(closes, high[at])
        some = b > a
        a, b, at = a[some], b[some], at[some]
        offset = starts[spot[some], s] + a - opens[some]
        yield rows[at], a + before, b - a, phase.first + number[some], offset


def queue_tokens(
    docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``key, doc_id, source, at, n, ids``: the ids of each text with a closing 0, as little-endian bytes.

    ``key`` names the source within its partition and ``at`` counts the tokens of the same
    key before the row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        open_queues: dict = {}
        for batch in batches:
            coder = coder or ByteIds(shared.value)
            for part in slices(batch, 1, size=1 << 23):
                number = part.column(3)[0].as_py() << 32
                ids = [coder.encode(text) for text in part.column(1).to_pylist()]
                keys, at = [], []
                for source, tokens in zip(part.column(2).to_pylist(), ids):
                    queue = open_queues.setdefault(source, [len(open_queues), 0])
                    keys.append(number | queue[0])
                    at.append(queue[1])
                    queue[1] += len(tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        part.column(0),
                        part.column(2),
                        pa.array(at, pa.int64()),
                        pa.array([len(tokens) for tokens in ids], pa.int64()),
                        pa.array([tokens.tobytes() for tokens in ids], pa.binary()),
                    ],
                    ["key", "doc_id", "source", "at", "n", "ids"],
                )

    chosen = docs.select(
        F.col(id_col).alias("doc_id"),
        body(text_col).alias("text"),
        F.col(source_col).alias("source"),
        F.spark_partition_id().cast("long").alias("number"),
    )
    kinds = chosen.schema["doc_id"].dataType.simpleString(), chosen.schema["source"].dataType.simpleString()
    return chosen.mapInArrow(encode, "key long, doc_id {}, source {}, at long, n long, ids binary".format(*kinds))


def mix_documents(
    docs: DataFrame,
    tokenizer_json: str | None = None,
    capacity: int = CAPACITY,
    targets: Mapping[str | None, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_bytes: int = 64 * 1024 * 1024,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source`` of whole documents.

    ``targets`` gives whole weights by source; sources it leaves out come last. Without it
    every window has the proportions of the table. Every token lies in exactly one piece;
    all sequences are full but the last few, which are powers of two. Sources beyond the
    ``MOST_QUEUES`` largest share one queue and its weight.

    NULL and empty texts have the closing 0 only; NULL is a source of its own; NULL or
    repeated ids and repeated rows are documents of their own; a text of any length is one
    row and is cut like others; ties between sources go to the one with more tokens, then
    by name; other columns are not read; an empty table gives no rows. Texts are encoded
    once; ids are kept in the checkpoint folder, where a lost task finds them.
    """
    spark = docs.sparkSession
    width = ByteIds(tokenizer_json := tokenizer_json or default_vocabulary()).width
    tokens = keep(queue_tokens(docs, tokenizer_json, id_col, text_col, source_col))
    # as many rows as partitions have sources
    totals = keep(tokens.groupBy("key", "source").agg(F.sum("n").alias("n")))
    sizes = totals.groupBy("source").agg(F.sum("n").cast("long").alias("total"))
    named = sizes.orderBy(F.desc("total"), "source").limit(MOST_QUEUES - 1).collect()
    others = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] - sum(row.total for row in named)
    kind = totals.schema["source"].dataType.simpleString()
    names = spark.createDataFrame([(row.source, i) for i, row in enumerate(named)], f"name {kind}, queue int")
    weights = None
    if targets is not None:
        rest = sum(targets.values()) - sum(targets.get(row.source, 0) for row in named)
        weights = [*(targets.get(row.source, 0) for row in named), rest if others else 0]
    phases = plan_windows([*(row.total for row in named), others], capacity, weights)

    earlier = W.partitionBy("queue").orderBy("key").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    queued = totals.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name")), "left")  # MOST_QUEUES rows
    places = queued.select("key", "n", F.coalesce("queue", F.lit(len(named))).alias("queue")).select(
        "key", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    placed = lookup_join(tokens, keep(places), "key", key_rows=totals.select("key", "n"), max_bytes=max_bytes)
    shared = share(spark, phases)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None
        for batch in batches:
            cutter = cutter or Cutter(pickle.loads(shared.value))
            for part in slices(batch, 5, size=1 << 24):
                queue, start, size = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                rows, place, length, sequence, offset = cutter.pieces(queue, start, size)
                flat = np.frombuffer(b"".join(part.column(5).to_pylist()), dtype=width).astype("<u4")
                raw = memoryview(flat).cast("B")
                start_in = place - start[rows]
                a = 4 * (start_in + (np.cumsum(size) - size)[rows])
                sums = [zlib.crc32(raw[i:j]) for i, j in zip(a.tolist(), (a + 4 * length).tolist())]
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(taken),
                        pa.array(start_in),
                        pa.array(length),
                        pa.array(sums, pa.int64()),
                        pa.array(size[rows]),
                        pa.array(sequence),
                        pa.array(offset),
                        part.column(1).take(taken),
                    ],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
                )

    kind_id = tokens.schema["doc_id"].dataType.simpleString()
    return placed.select("doc_id", "source", "queue", (F.col("base") + F.col("at")).alias("start"), "n", "ids").mapInArrow(
        cut,
        f"doc_id {kind_id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        f"offset long, source {kind}",
    )


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))
