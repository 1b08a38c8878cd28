"""Toxicity by nearest labelled examples under exact TF-IDF cosine, searched by block maxima.

Terms are all words of the labelled examples, and those beginnings of words that tell the
label. The TF-IDF weight of a term is drawn towards zero, but never to it, where its
documents have label 1 no more often than chance gives: by TF-IDF alone the many harmless
words decide who is near. Tokens with none of the terms count together as one more term.

Examples stand in blocks of similar ones. A search adds up the postings of rare terms
first. Each block then has a bound: the best sum in it, and for each common term the
greatest weight in the block. Blocks whose bound is below the ``k``-th best cosine found
so far are skipped, the others are finished with their common terms, so the neighbours
are exact. Votes weighted by closeness give the score, calibrated on the examples with
each left out.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import body, give_back, share, table

EXAMPLES = 20_000  # labelled rows to learn from, at most
LEAST_CHI2 = 30.0  # from a difference this large on a term has most of its weight; none is left out below it
LEAST_TOXIC = 5  # beginnings of words need so many examples with label 1
COMMON = 8  # terms of one in so many examples come last, block by block
SLICED = 64  # postings from which on a term has a list of its own at hand
BLOCK = 64  # examples that share a bound
TEXTS_AT_ONCE = 128
CHARS_AT_ONCE = 1 << 22  # of texts whose terms are counted together
NEIGHBOURS = 15
REMEMBERED = 300_000
BEGINNINGS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_WORD_OR_END = re.compile(r"[^\W\d_]+|\n")


def terms_of(token: str) -> list[str]:
    """Words in a piece of text without white space, and their beginnings (marked by a hyphen)."""
    found = []
    for word in _WORD.findall(token.lower()):
        found.append(word)
        found.extend(word[:n] + "-" for n in BEGINNINGS if len(word) > n)
    return found


def _digest(term: str) -> int:
    """64 bits that stand for a term; among a million terms two meet once in thirty million times."""
    return xxhash.xxh3_64_intdigest(term) - (1 << 63)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """``doc_id, label, text`` of at most ``most`` labelled texts that are not held out.

    The bound is on the rows of the sample: on pairs of id and text that are in ``docs``,
    each once, chosen by a hash. Narrow rows are joined; only the texts chosen move.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_learn_id"))
        .agg(F.max(label).alias("_learn_label"))
    )
    texts = docs.select(F.col(id_col).alias("_learn_id"), body(text_col).alias("_learn_text"))
    texts = texts.withColumn("_learn_hash", F.xxhash64("_learn_text"))
    chosen = (
        texts.select("_learn_id", "_learn_hash")
        .distinct()
        .join(known, "_learn_id")
        .orderBy(F.xxhash64("_learn_id", "_learn_hash"), "_learn_id", "_learn_hash")
        .limit(most)
    )
    joined = texts.join(F.broadcast(chosen), ["_learn_id", "_learn_hash"]).dropDuplicates(["_learn_id", "_learn_hash"])
    return joined.select(
        F.col("_learn_id").alias("doc_id"), F.col("_learn_label").cast("int").alias("label"), F.col("_learn_text").alias("text")
    )


def choose_terms(sample: DataFrame) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, int, int]:
    """(digests of the terms in order, beginnings among them, documents with each, chi-squared of each and the label, documents, of them with label 1).

    All words of the sample, and the beginnings of words that tell the label; none where
    one of the labels is missing.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        rows = [0, 0]
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                side = int(label == 1)
                rows[side] += 1
                words = set(_WORD.findall(text.lower()))  # as in terms_of: no word holds white space
                seen[side].update(words)
                seen[side].update({word[:n] + "-" for word in words for n in BEGINNINGS if len(word) > n})
        terms = list(set(seen[0]) | set(seen[1]))
        yield pa.RecordBatch.from_pydict(
            {
                "term": pa.array([None, *map(_digest, terms)], pa.int64()),
                "beginning": pa.array([None, *(t if t[-1] == "-" else None for t in terms)], pa.string()),
                "clean": pa.array([rows[0], *(seen[0][t] for t in terms)], pa.int64()),
                "toxic": pa.array([rows[1], *(seen[1][t] for t in terms)], pa.int64()),
            }
        )

    counted = sample.select("label", "text").mapInArrow(add_up, "term long, beginning string, clean long, toxic long")
    counts = counted.groupBy("term", "beginning").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = counts.filter(F.col("beginning").isNull() | (F.col("toxic") >= LEAST_TOXIC)).toArrow()
    clean, toxic = (found.column(c).to_numpy().astype(np.float64) for c in ("clean", "toxic"))
    whole = pc.is_null(found.column("term")).to_numpy()
    n, ones = int(clean[whole].sum() + toxic[whole].sum()), int(toxic[whole].sum())
    if not 0 < ones < n:
        return np.zeros(0, dtype=np.int64), [], np.zeros(0), np.zeros(0), n, ones
    terms = pc.fill_null(found.column("term"), 0).to_numpy()
    m = clean + toxic
    spread = m * (n - m) * (ones / n) * (1 - ones / n)
    chi2 = np.divide(n * (toxic - m * ones / n) ** 2, spread, out=np.zeros(len(m)), where=spread > 0)
    word = pc.is_null(found.column("beginning")).to_numpy()
    taken = np.flatnonzero(~whole & (word | (chi2 >= LEAST_CHI2)))
    taken = taken[np.argsort(terms[taken])]
    beginnings = found.column("beginning").take(taken[~word[taken]]).to_pylist()
    return terms[taken], beginnings, m[taken], chi2[taken], n, ones


def _side_by_side(space: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """An order of the rows in which those that lie close make up the blocks: halves along the widest leading direction. Moves ``space``."""
    order = np.argsort(ids, kind="stable")
    if not space.shape[1]:
        return order
    space -= space.mean(axis=0)
    leading = space @ np.linalg.eigh(space.T @ space)[1][:, -8:]
    parts, done = [order], []
    while parts:
        part = parts.pop()
        if len(part) <= BLOCK:
            done.append(part)
            continue
        own = leading[part]
        part = part[np.argsort(own[:, np.argmax(own.var(axis=0))], kind="stable")]
        cut = max(len(part) // 2 // BLOCK, 1) * BLOCK
        parts += [part[cut:], part[:cut]]
    return np.concatenate(done)


class Index:
    """Terms, weights of the examples by term, and what a search needs to score a text."""

    def __init__(
        self, terms: Sequence, df: Sequence[int], docs: int, chi2: Sequence[float] | None = None, beginnings: Sequence[str] = ()
    ):
        self.terms = np.asarray(terms)
        self.beginnings = list(beginnings)
        self.other = len(terms)  # stands for all tokens without a term
        self.idf = np.log((1 + docs) / (1 + np.array([*df, docs], dtype=np.float64))) + 1
        if chi2 is not None:
            more = np.array([*chi2, 0.0]) + 1  # chance alone gives 1 on average
            self.idf *= np.sqrt(more / (more + LEAST_CHI2))
        self.ids = np.zeros(0, dtype=np.int64)
        self.labels = np.zeros(0)
        self.bare = 0  # examples with none of the terms; they lie in one direction
        self.bare_score = 0.0  # share of label 1 among them
        self.prior = 0.0
        self.scale = (4.0, -2.0)  # calibration: slope and shift
        self.rows = np.zeros(0, dtype=np.uint16)  # postings by term, those with the same count in a run
        self.run_tf = np.zeros(0, dtype=np.uint16)
        self.run_sizes = np.zeros(0, dtype=np.uint16)
        self.runs = np.zeros(self.other + 1, dtype=np.uint8)  # runs of each term
        self.sizes = np.zeros(self.other + 1, dtype=np.uint16)  # postings of each term
        self.norms = np.zeros(0)
        self.visited = 0  # blocks finished so far
        self._weigh()

    def __getstate__(self) -> dict:
        # the matrix is made again from the counts, so that little is sent to the executors
        state = self.__dict__ | {"dense": None, "maxima": None, "levels": None, "run_starts": None, "starts": None, "lists": None}
        return {"packed": zlib.compress(pickle.dumps(state, protocol=5), 1)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(pickle.loads(zlib.decompress(state["packed"])))
        self._weigh()

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights of length 1) of a text with these term counts."""
        terms = np.fromiter(counts.keys(), np.int64, len(counts))
        tf = np.fromiter(counts.values(), np.float64, len(counts))
        order = np.argsort(terms)
        terms, tf = terms[order], tf[order]
        weights = (1 + np.log(tf)) * self.idf[terms]
        return terms, weights / np.sqrt((weights * weights).sum())

    def build(self, examples: list[tuple[int, int, dict[int, int]]]) -> None:
        """Index of (id, label, term counts)."""
        flat = np.array([x for _, _, counts in examples for pair in counts.items() for x in pair], dtype=np.int32)
        self.build_flat(
            np.array([e[0] for e in examples], dtype=np.int64),
            np.array([e[1] for e in examples], dtype=np.float64),
            np.array([len(e[2]) for e in examples], dtype=np.int64),
            flat[::2],
            flat[1::2],
        )

    def build_flat(self, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        """Index of examples; ``terms`` and ``tf`` hold ``sizes`` values for each. Similar ones come to stand together."""
        n = len(ids)
        norms = np.zeros(n)
        ends = np.cumsum(sizes).tolist()
        for i, (a, b) in enumerate(zip([0, *ends], ends)):
            own = (1 + np.log(tf[a:b].astype(np.float64))) * self.idf[terms[a:b]]
            norms[i] = np.sqrt((own * own).sum())
        counts = np.bincount(terms, minlength=self.other + 1)
        row_of = np.repeat(np.arange(n, dtype=np.int32), sizes)
        common = np.flatnonzero(counts * COMMON > n)
        held = np.full(self.other + 1, -1)
        held[common] = np.arange(len(common))
        picked = np.flatnonzero(held[terms] >= 0)
        space = np.zeros((n, len(common)))
        space[row_of[picked], held[terms[picked]]] = (
            (1 + np.log(tf[picked].astype(np.float64))) * self.idf[terms[picked]] / norms[row_of[picked]]
        )
        order = _side_by_side(space, ids)
        del space, picked, held
        place = np.empty(n, dtype=np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        self.ids, self.labels, self.norms = ids[order], labels[order], norms[order]
        # term, count and row as one number each, sorted where they lie
        above = int(tf.max(initial=0)) + 1
        keys = terms.astype(np.int64)
        keys *= above
        keys += tf
        keys *= n
        for a in range(0, len(keys), 1 << 20):
            keys[a : a + (1 << 20)] += place[row_of[a : a + (1 << 20)]]
        del row_of
        keys.sort()
        self.rows = np.empty(len(keys), dtype=np.min_scalar_type(n))
        for a in range(0, len(keys), 1 << 20):
            self.rows[a : a + (1 << 20)] = keys[a : a + (1 << 20)] % n
            keys[a : a + (1 << 20)] //= n
        firsts = np.flatnonzero(np.append(np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]))
        run_sizes = np.diff(firsts, append=len(keys))
        run_terms, run_tf = keys[firsts] // above, keys[firsts] % above
        del keys
        runs = np.bincount(run_terms, minlength=self.other + 1)
        self.run_tf, self.run_sizes, self.runs, self.sizes = (
            x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (run_tf, run_sizes, runs, counts)
        )
        self._weigh()

    def _weigh(self) -> None:
        """What follows from counts and norms: where terms and runs start, block maxima of common terms."""
        self.starts = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        self.run_starts = np.concatenate([[0], np.cumsum(self.runs, dtype=np.int64)])
        self.levels = 1 + np.log(self.run_tf.astype(np.float64))
        self.lists = {
            t: self.rows[self.starts[t] : self.starts[t + 1]] for t in np.flatnonzero(self.sizes >= SLICED).tolist()
        }
        self.common = np.flatnonzero(self.sizes.astype(np.int64) * COMMON > len(self.ids))
        self.blocks = -(-len(self.ids) // BLOCK)
        self.inverse = np.zeros(self.blocks * BLOCK)
        self.inverse[: len(self.ids)] = 1 / self.norms
        self.dense = np.zeros((self.blocks * BLOCK, len(self.common)))  # weights of common terms, one row for each example
        for i, t in enumerate(self.common.tolist()):
            self.dense[self.rows[self.starts[t] : self.starts[t + 1]], i] = self.weights_of(np.array([t]))
        self.maxima = self.dense.reshape(self.blocks, BLOCK, len(self.common)).max(axis=1).T if self.blocks else self.dense.T

    def _runs_of(self, terms: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(level of the count times the factor of the term, postings) of each run of these terms."""
        firsts, runs = self.run_starts[terms], self.runs[terms].astype(np.int64)
        own = np.repeat(firsts - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        return self.levels[own] * np.repeat(factors, runs), self.run_sizes[own]

    def _rows_of(self, terms: np.ndarray) -> np.ndarray:
        """Rows of the postings of these terms."""
        sizes = self.sizes[terms].astype(np.int64)
        return self.rows[np.repeat(self.starts[terms] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]

    def weights_of(self, terms: np.ndarray) -> np.ndarray:
        """Weights of the postings of these terms."""
        return np.repeat(*self._runs_of(terms, self.idf[terms])) / self.norms[self._rows_of(terms)]

    @property
    def weights(self) -> np.ndarray:
        """Weights of all postings; not kept, as they are larger than all else."""
        return self.weights_of(np.arange(self.other + 1))

    def _rare_sums(self, vectors: list[tuple[np.ndarray, np.ndarray]], out: np.ndarray) -> None:
        """What terms that are not common add to the cosine of each (terms, weights) with each example."""
        for start in range(0, len(vectors), 8):  # few at once: a long text has many runs
            part = vectors[start : start + 8]
            terms, weights = (np.concatenate(column) for column in zip(*part))
            text = np.repeat(np.arange(len(part)), [len(own) for own, _ in part])
            short = self.sizes[terms] < SLICED
            order = np.argsort(2 * text + short, kind="stable")  # by text, those with a list of their own first
            terms, weights, text, short = terms[order], weights[order], text[order], short[order]
            each = np.arange(len(part) + 1)
            few, long = terms[short], terms[~short]
            few_rows = self._rows_of(few)
            few_cuts = np.searchsorted(text[short], each)
            few_cuts = np.concatenate([[0], np.cumsum(self.sizes[few], dtype=np.int64)])[few_cuts].tolist()
            lists = [self.lists[t] for t in long.tolist()]
            long_cuts = np.searchsorted(text[~short], each).tolist()
            values, sizes = self._runs_of(terms, weights * self.idf[terms])
            ends = np.cumsum(self.runs[terms], dtype=np.int64)
            cuts = np.concatenate([[0], ends])[np.searchsorted(text, each)].tolist()
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                rows = np.concatenate([*lists[long_cuts[i] : long_cuts[i + 1]], few_rows[few_cuts[i] : few_cuts[i + 1]]])
                added = np.bincount(rows, np.repeat(values[a:b], sizes[a:b]), self.blocks * BLOCK)
                np.multiply(added, self.inverse, out=out[start + i])

    def search(
        self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, floors: Sequence[float], skips: Sequence[int] | None = None
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, cosines) of the ``k`` nearest examples above its floor for each (terms, weights).

        Nearest first, ties by id. ``skips`` are rows left out, one for each text.
        """
        if not self.blocks or not vectors:
            return [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(vectors)
        some = np.zeros((len(vectors), len(self.common)))
        sums = np.empty((len(vectors), self.blocks * BLOCK))
        rare = []
        for i, (terms, weights) in enumerate(vectors):
            at = np.searchsorted(self.common, terms)
            inside = at < len(self.common)
            inside[inside] = self.common[at[inside]] == terms[inside]
            some[i, at[inside]] = weights[inside]
            rare.append((terms[~inside], weights[~inside]))
        self._rare_sums(rare, sums)
        leaders = sums.reshape(len(vectors), self.blocks, BLOCK).argmax(axis=2) + np.arange(self.blocks) * BLOCK
        tops = np.take_along_axis(sums, leaders, axis=1)
        bounds = tops + some @ self.maxima
        # the k-th best of a few promising examples, one of a block, is a threshold that the k-th best of all reaches
        own = k + (skips is not None)
        least = np.array(floors, dtype=np.float64)
        if own <= self.blocks:
            tried = np.argpartition(tops, -min(2 * own, self.blocks), axis=1)[:, -2 * own :]
            exact = np.take_along_axis(tops, tried, axis=1)
            exact += (self.dense[np.take_along_axis(leaders, tried, axis=1)] @ some[:, :, None])[:, :, 0]
            least = np.maximum(least, np.partition(exact, -own, axis=1)[:, -own])
        open_blocks = bounds >= least[:, None] - 1e-9
        for block in np.flatnonzero(open_blocks.any(axis=0)).tolist():
            texts = np.flatnonzero(open_blocks[:, block])
            a, b = block * BLOCK, (block + 1) * BLOCK
            sums[texts, a:b] += some[texts] @ self.dense[a:b].T
        self.visited += int(open_blocks.sum())
        found = []
        for i, floor in enumerate(floors):
            rows = np.flatnonzero((sums[i].reshape(self.blocks, BLOCK) >= least[i] - 1e-9) & open_blocks[i, :, None])
            cosines = np.round(sums[i, rows], 12)
            taken = cosines > floor
            if skips is not None:
                taken &= rows != skips[i]
            rows, cosines = rows[taken], cosines[taken]
            best = np.lexsort((self.ids[rows], -cosines))[:k]
            found.append((rows[best], cosines[best]))
        return found

    def nearest(
        self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1, floor: float = 0.0
    ) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the ``k`` nearest examples above ``floor``, nearest first, ties by id."""
        return self.search([(terms, weights)], k, [floor], [skip] if skip >= 0 else None)[0]

    def _floor(self, bare_cosine: float) -> float:
        """Closeness that examples without terms reach anyway, if there are enough of them to fill all places."""
        return bare_cosine if self.bare >= NEIGHBOURS else 0.0

    def vote(self, rows: np.ndarray, cosines: np.ndarray, bare_cosine: float) -> float:
        """Share of label 1 among the nearest, each weighted by its closeness, with a little of the prior.

        Examples without terms are all at ``bare_cosine`` and take the places it earns them.
        """
        nearer = int((cosines > bare_cosine).sum())
        bare = min(max(NEIGHBOURS - nearer, 0), self.bare)
        some = np.minimum(cosines[: NEIGHBOURS - bare], 1.0)
        weights = 1 / (1.05 - some)
        bare_weight = bare / (1.05 - min(bare_cosine, 1.0))
        ones = (weights * self.labels[rows[: len(some)]]).sum() + bare_weight * self.bare_score + self.prior
        return float(ones / (weights.sum() + bare_weight + 1))

    def calibrate(self) -> None:
        """Fits the logistic curve from votes to labels, each example judged without itself."""
        if len(self.ids) < 2 or len(np.unique(self.labels)) < 2:
            return
        chosen = range(0, len(self.ids), max(1, len(self.ids) // 2000))
        place = {row: i for i, row in enumerate(chosen)}
        wanted = np.zeros(len(self.ids), dtype=bool)
        wanted[list(chosen)] = True
        picked = np.concatenate(
            [a + np.flatnonzero(wanted[self.rows[a : a + (1 << 20)]]) for a in range(0, len(self.rows), 1 << 20)]
        )
        terms = np.searchsorted(self.starts, picked, side="right") - 1
        level = self.levels[np.searchsorted(np.cumsum(self.run_sizes, dtype=np.int64), picked, side="right")]
        weights = level * self.idf[terms] / self.norms[self.rows[picked]]
        rows = np.array([place[r] for r in self.rows[picked].tolist()])
        order = np.argsort(rows, kind="stable")
        cuts = np.searchsorted(rows[order], np.arange(1, len(chosen)))
        vectors = list(zip(np.split(terms[order], cuts), np.split(weights[order], cuts)))
        del picked, terms, level, weights, rows, order
        votes = []
        for start in range(0, len(chosen), TEXTS_AT_ONCE):
            part = vectors[start : start + TEXTS_AT_ONCE]
            away = [float(weights[own == self.other].sum()) for own, weights in part]
            found = self.search(part, NEIGHBOURS, [self._floor(a) for a in away], chosen[start : start + TEXTS_AT_ONCE])
            votes += [self.vote(*near, a) for near, a in zip(found, away)]
        votes = np.array(votes)
        y = self.labels[list(chosen)]
        x = np.stack([votes, np.ones(len(votes))], axis=1)
        b = np.array(self.scale)
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ b))
            slope = x.T @ (y - p) - 0.01 * b
            bend = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
            b = b + np.linalg.solve(bend, slope)
        if np.isfinite(b).all() and b[0] > 0:
            self.scale = (float(b[0]), float(b[1]))

    def score(self, texts: list[dict[int, int]]) -> list[tuple[float, list[int], list[float]]]:
        """(score, ids of the neighbours, their cosines) of texts with these term counts."""
        return self.score_vectors([self.vector(c) if any(t != self.other for t in c) else None for c in texts])

    def score_counts(
        self, texts: int, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray
    ) -> list[tuple[float, list[int], list[float]]]:
        """The same for so many texts from what ``TermCounter.count_all`` gives."""
        bounds = np.searchsorted(rows, np.arange(texts + 1)).tolist()
        weights = (1 + np.log(tf)) * self.idf[terms]
        vectors = []
        for a, b in zip(bounds, bounds[1:]):
            own = weights[a:b]
            # the term of all other tokens comes last
            vectors.append((terms[a:b], own / np.sqrt((own * own).sum())) if a < b and terms[a] != self.other else None)
        return self.score_vectors(vectors)

    def score_vectors(
        self, texts: list[tuple[np.ndarray, np.ndarray] | None]
    ) -> list[tuple[float, list[int], list[float]]]:
        """The same for (terms, weights), None for a text without any term."""
        out = [(self.bare_score, [], [])] * len(texts)
        known = [i for i, vector in enumerate(texts) if vector is not None and len(self.ids)]
        for start in range(0, len(known), TEXTS_AT_ONCE):
            part = known[start : start + TEXTS_AT_ONCE]
            vectors = [texts[i] for i in part]
            away = [float(weights[terms == self.other].sum()) for terms, weights in vectors]
            found = self.search(vectors, NEIGHBOURS, [self._floor(a) for a in away])
            for i, (rows, cosines), apart in zip(part, found, away):
                vote = self.vote(rows, cosines, apart)
                score = 1 / (1 + math.exp(-(self.scale[0] * vote + self.scale[1])))
                out[i] = (score, self.ids[rows].tolist(), cosines.tolist())
        return out


class TermCounter:
    """Counts of the terms in texts; which terms a token has is remembered, up to a bound."""

    def __init__(self, terms: np.ndarray, beginnings: Sequence[str]):
        self.terms = terms  # digests in order
        self.beginnings = {b: int(np.searchsorted(terms, _digest(b))) for b in beginnings}
        self.heads = {b[: BEGINNINGS[0]] for b in beginnings}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = defaultdict(count().__next__)  # numbers tokens as they come
        self.starts = np.zeros(1, dtype=np.int64)  # where the terms of each known token start in ``found``
        self.found = np.zeros(0, dtype=np.int32)

    def learn(self, tokens: list[str]) -> None:
        items = _WORD_OR_END.findall("\n".join([*tokens, ""]).lower())  # tokens have no white space in them
        at_end = np.fromiter(map("\n".__eq__, items), bool, len(items))
        owner = np.cumsum(at_end)[~at_end]
        items = [item for item in items if item != "\n"]
        digests = np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))
        digests = (digests ^ np.uint64(1 << 63)).view(np.int64)  # as in _digest
        at = np.searchsorted(self.terms, digests)
        inside = np.flatnonzero(at < len(self.terms))
        inside = inside[self.terms[at[inside]] == digests[inside]]
        begins = self.beginnings
        starts = [
            (i, begins[start])
            for i in [i for i, word in enumerate(items) if word[: BEGINNINGS[0]] in self.heads]
            for n in BEGINNINGS
            if len(items[i]) > n and (start := items[i][:n] + "-") in begins
        ]
        places, terms = np.array(starts, dtype=np.int64).reshape(-1, 2).T
        owners, found = np.concatenate([owner[inside], owner[places]]), np.concatenate([at[inside], terms])
        without = np.flatnonzero(np.bincount(owners, minlength=len(tokens)) == 0)
        owners = np.concatenate([owners, without])
        found = np.concatenate([found, np.full(len(without), len(self.terms))])
        found = found[np.argsort(owners, kind="stable")]
        ends = np.cumsum(np.bincount(owners, minlength=len(tokens)))
        self.starts = np.concatenate([self.starts, len(self.found) + ends])
        self.found = np.concatenate([self.found, found.astype(np.int32)])

    def count_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, terms, occurrences) by text, then term; each token without a term counts as one of the term after the last."""
        none = np.zeros(0, dtype=np.int64)
        parts, start = [(none, none, none)], 0
        while start < len(texts):
            size, end, codes, before = 0, start, [], len(self.known)
            while end < len(texts) and (end == start or size + len(texts[end]) <= CHARS_AT_ONCE):
                tokens = texts[end].split()
                codes.append(np.fromiter(map(self.known.__getitem__, tokens), np.int32, len(tokens)))
                size += len(texts[end])
                end += 1
            if len(self.known) > before:
                self.learn(list(islice(reversed(self.known), len(self.known) - before))[::-1])
            parts.append(self._add_up(start, codes))
            start = end
            if len(self.known) > REMEMBERED:
                self.forget()
        return tuple(np.concatenate(column) for column in zip(*parts))

    def _add_up(self, first: int, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of texts, numbered from ``first``, whose tokens have these numbers."""
        tokens = np.concatenate(codes)
        begin = self.starts[tokens]
        sizes = self.starts[tokens + 1] - begin
        ends = np.cumsum(sizes)
        keys = self.found[np.repeat(begin - ends + sizes, sizes) + np.arange(sizes.sum())].astype(np.int64)
        each = len(self.terms) + 1
        keys += np.repeat(np.repeat(np.arange(first, first + len(codes)) * each, [len(c) for c in codes]), sizes)
        keys.sort()
        firsts = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[firsts] // each, keys[firsts] % each, np.diff(firsts, append=len(keys))

    def count(self, text: str) -> dict[int, int]:
        """Occurrences of each term in a text."""
        _, terms, tf = self.count_all([text])
        return dict(zip(terms.tolist(), tf.tolist()))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = EXAMPLES
) -> Index:
    """Index of at most ``most`` labelled rows that are not held out; rows without any term are counted only."""
    sample = labelled_sample(docs, labels, label, id_col, text_col, most)
    terms, beginnings, df, chi2, n, ones = choose_terms(sample)
    pa.default_memory_pool().release_unused()
    index = Index(terms, df, n, chi2, beginnings)
    index.prior = ones / n if n else 0.0
    index.bare_score = index.prior
    if not len(terms):
        return index
    shared = share(docs.sparkSession, (terms, beginnings))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(*pickle.loads(shared.value))
        for batch in batches:
            texts, numbers, tf = counter.count_all(batch.column(2).to_pylist())
            flat = np.stack([numbers, tf], axis=1).astype(np.int32).ravel()
            ends = 2 * np.searchsorted(texts, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), lists], ["doc_id", "label", "counts"])

    found = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(
        vectors, "doc_id long, label int, counts array<int>"
    )
    made = found.toArrow()
    counts = made.column("counts")
    sizes = pc.list_value_length(counts).to_numpy() // 2
    ids = made.column("doc_id").to_numpy()
    ones_of = (made.column("label").to_numpy() == 1).astype(np.float64)
    parts = [part.flatten().to_numpy() for part in counts.chunks]
    flat_terms = np.concatenate([part[::2] for part in parts])
    most_tf = max((int(part[1::2].max(initial=0)) for part in parts), default=0)
    flat_tf = np.concatenate([part[1::2].astype(np.min_scalar_type(most_tf)) for part in parts])
    del made, counts, parts, found
    pa.default_memory_pool().release_unused()
    row_of = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    own = np.bincount(row_of[flat_terms != index.other], minlength=len(ids)) > 0
    inside = own[row_of]
    del row_of
    index.bare = int((~own).sum())
    index.bare_score = float((ones_of[~own].sum() + 0.5 * index.prior) / (index.bare + 0.5))
    if not inside.all():
        flat_terms, flat_tf = flat_terms[inside], flat_tf[inside]
    del inside
    index.build_flat(ids[own], ones_of[own], sizes[own], flat_terms, flat_tf)
    del flat_terms, flat_tf
    give_back()
    index.calibrate()
    return index


def score_column(spark: SparkSession, index: Index, text: Column) -> Column:
    """Struct ``score, neighbours, cosines`` for a text column."""
    shared = share(spark, index)

    @F.pandas_udf("score double, neighbours array<long>, cosines array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found_index = pickle.loads(shared.value)
        counter = TermCounter(found_index.terms, found_index.beginnings)
        for texts in batches:
            found = []
            for start in range(0, len(texts), TEXTS_AT_ONCE):
                part = texts[start : start + TEXTS_AT_ONCE].tolist()
                found += found_index.score_counts(len(part), *counter.count_all(part))
            yield pd.DataFrame(found, columns=["score", "neighbours", "cosines"])

    return scored(text)


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", most: int = EXAMPLES
) -> DataFrame:
    """``doc_id, held_out, score, predicted, neighbours, cosines`` for each row; ``predicted`` is 1 from 0.5 on.

    The neighbours are the evidence: ids of the nearest labelled rows. Every text with a
    word of a labelled one is searched. A text without, such as a NULL or empty one, has no neighbours and the share of label 1 among
    labelled texts of that kind. Without labels every score is 0. Only the text enters a
    score. NULL ids are not held out; rows with the same id are scored each for itself;
    an empty table gives no rows.
    """
    scored = score_column(docs.sparkSession, fit(docs, labels, label, id_col, text_col, most), body(text_col))
    give_back()  # the driver needs the index no longer
    chosen = docs.select(F.col(id_col).alias("doc_id"), scored.alias("s"))
    return chosen.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("s.score").alias("score"),
        (F.col("s.score") >= 0.5).cast("int").alias("predicted"),
        F.col("s.neighbours").alias("neighbours"),
        F.col("s.cosines").alias("cosines"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; all columns stay."""
    scored = score_column(docs.sparkSession, fit(docs, labels, id_col=id_col, text_col=text_col), body(text_col))
    give_back()  # the driver needs the index no longer
    return docs.withColumn("__toxicity", scored).filter(F.col("__toxicity.score") < 0.5).drop("__toxicity")


def op8_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
