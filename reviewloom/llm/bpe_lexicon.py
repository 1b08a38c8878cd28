"""Byte-level BPE with a lexicon of frequent words in a minimal acyclic automaton.

Frequent words are compiled into an automaton that shares prefixes and suffixes. Each
edge counts the words before it, so a path also gives the word's number and with it
the word's ids. Workers map the compiled arrays into memory. Words that the lexicon
lacks are merged exactly, pair by pair.
"""

from __future__ import annotations

import json
import mmap
import re
import tempfile
import unicodedata
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import body, give_back, slices, table

LEXICON_WORDS = 50_000
COUNTED_AT_ONCE = 500_000
REMEMBERED = 400_000
TEXTS_AT_ONCE, BYTES_AT_ONCE = 1000, 1 << 22
WIDEST = 48  # longest words that are merged side by side
# How this family of tokenizers cuts texts into words
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STABLE = "԰"  # character classes below it are the same in every Unicode version in use


def byte_letters() -> list[str]:
    """Letter that stands for each byte in the vocabulary: itself if visible, else one from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return [chr(b) if b in set(visible) else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Vocabulary and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, content: str):
        model = json.loads(content)
        letters = byte_letters()
        back = {letter: b for b, letter in enumerate(letters)}
        ids = model["model"]["vocab"]
        self.bytes_of = {i: bytes(back[c] for c in word) for word, i in ids.items()}
        self.byte_ids = [ids[letter] for letter in letters]
        end = model["model"].get("end_of_word_suffix") or ""
        self.end_ids = [ids[letter + end] for letter in letters]  # of a word's last byte
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[left] << 32 | ids[right]] = rank
            self.merged.append(ids[left + right])
        self.special = {token["content"]: token["id"] for token in model["added_tokens"]}
        self.bytes_of.update({i: content.encode() for content, i in self.special.items()})
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._words = regex.compile(PATTERN)
        self._content = content
        self._library = None
        self._pairs = None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair with the lowest rank is merged first, from the left."""
        ids = [self.byte_ids[b] for b in word[:-1]] + [self.end_ids[b] for b in word[-1:]]
        none = len(self.merged)
        get = self.ranks.get
        while len(ids) > 1:
            found = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
            best = min(found)
            if best == none:
                break
            new, out, i, last = self.merged[best], [], 0, len(found)
            while i < last:
                if found[i] == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            if i == last:
                out.append(ids[i])
            ids = out
        return ids

    def _pair_table(self) -> tuple[np.ndarray, ...]:
        """Sorted pairs, their ranks, merged ids by rank, and the rank of each pair of bytes, inside and at the end."""
        if self._pairs is None:
            pairs = np.fromiter(self.ranks, dtype=np.int64, count=len(self.ranks))
            ranks = np.fromiter(self.ranks.values(), dtype=np.int64, count=len(self.ranks))
            order = np.argsort(pairs)
            none = len(self.merged)
            inner, last = (
                np.array([[self.ranks.get(a << 32 | b, none) for b in right] for a in self.byte_ids])
                for right in (self.byte_ids, self.end_ids)
            )
            self._pairs = (pairs[order], ranks[order], np.array([*self.merged, 0], dtype=np.int64), inner, last)
        return self._pairs

    def _merge_alike(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` for words of the same length side by side: each step merges one pair in every word."""
        pairs, ranks, merged, inner, last = self._pair_table()
        none = len(self.merged)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)
        ids = np.array(self.byte_ids, dtype=np.int64)[raw]
        ids[:, -1] = np.array(self.end_ids, dtype=np.int64)[raw[:, -1]]
        count = np.full(len(words), ids.shape[1])
        found = np.full(ids.shape, none, dtype=np.int64)  # rank of the pair that starts here
        found[:, :-1] = inner[raw[:, :-1], raw[:, 1:]]
        found[:, -2:-1] = last[raw[:, -2:-1], raw[:, -1:]]
        rows = np.arange(len(words))
        places = np.arange(ids.shape[1])
        while len(rows):
            at = found[rows].argmin(axis=1)
            best = found[rows, at]
            rows, at, best = rows[best < none], at[best < none], best[best < none]
            if not len(rows):
                break
            width = int(count[rows].max())
            kept = places[:width] + (places[:width] > at[:, None])  # drops the right half of the pair
            kept = np.minimum(kept, width - 1)
            ids[rows, at] = merged[best]
            ids[rows, :width] = np.take_along_axis(ids[rows, :width], kept, 1)
            found[rows, :width] = np.take_along_axis(found[rows, :width], kept, 1)
            count[rows] -= 1
            found[rows, count[rows] - 1] = none
            for spot in (at - 1, at):  # the two pairs that hold the new id
                ok = (spot >= 0) & (spot < count[rows] - 1)
                r, q = rows[ok], spot[ok]
                wanted = ids[r, q] << 32 | ids[r, q + 1]
                near = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
                found[r, q] = np.where(pairs[near] == wanted, ranks[near], none)
        return [line[:n] for line, n in zip(ids.tolist(), count.tolist())]

    def merge_many(self, words: Sequence[bytes]) -> list[list[int]]:
        """Ids of many words."""
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        out: list[list[int]] = [[]] * len(words)
        for length, places in by_length.items():
            few = not 2 <= length <= WIDEST or len(places) < 8 or not self.merged
            some = [words[i] for i in places]
            for i, ids in zip(places, map(self.merge, some) if few else self._merge_alike(some)):
                out[i] = ids
        return out

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens, cut as the library cuts them."""
        if max(text, default="") < STABLE or not any(unicodedata.category(c) == "Cn" for c in text):
            return self._words.findall(text)
        if self._library is None:  # characters newer than one of the two Unicode tables
            from tokenizers.pre_tokenizers import ByteLevel

            self._library = ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str | int]:
        """Words and the ids of special tokens, in order."""
        if not self.special or self._special.search(text) is None:
            return self.words(text)
        found: list[str | int] = []
        for i, part in enumerate(self._special.split(text)):
            found.extend([self.special[part]] if i % 2 else self.words(part))
        return found


def compile_lexicon(entries: dict[bytes, Sequence[int]]) -> bytes:
    """Minimal acyclic automaton of the words with their ids, as one block of bytes."""
    words = sorted(entries)
    nodes: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (parent, byte, child), not yet shared

    def share(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            same = register.setdefault((final[child], tuple(nodes[child].items())), child)
            nodes[parent][byte] = same

    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        share(common)
        at = path[-1][2] if path else 0
        for byte in word[common:]:
            nodes.append({})
            final.append(False)
            nodes[at][byte] = len(nodes) - 1
            path.append((at, byte, len(nodes) - 1))
            at = len(nodes) - 1
        final[at] = True
        last = word
    share(0)

    number = {0: 0}
    order = [0]
    for node in order:  # grows while it is walked
        for child in nodes[node].values():
            if child not in number:
                number[child] = len(order)
                order.append(child)
    below: dict[int, int] = {}
    stack = [0]
    while stack:
        node = stack[-1]
        open_children = [c for c in nodes[node].values() if c not in below]
        if open_children:
            stack.extend(open_children)
        else:
            below[node] = final[node] + sum(below[c] for c in nodes[node].values())
            stack.pop()
    edges = []
    for node in order:
        before = int(final[node])
        for byte, child in sorted(nodes[node].items()):
            edges.append((number[node] << 8 | byte, number[child], before))
            before += below[child]
    edges.sort()
    keys, targets, skips = (np.array([e[i] for e in edges], dtype=np.int64) for i in range(3))
    ends = np.array([final[node] for node in order], dtype=np.int64)
    starts = np.cumsum([0, *(len(entries[w]) for w in words)], dtype=np.int64)
    ids = np.array([i for w in words for i in entries[w]], dtype=np.int64)
    parts = [keys, targets, skips, ends, starts, ids]
    return b"".join([np.array([len(p) for p in parts], dtype=np.int64).tobytes(), *(p.tobytes() for p in parts)])


class Lexicon:
    """The compiled automaton, mapped into memory from a file that goes with the process."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(block)
            file.flush()
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self._map, dtype=np.int64, count=6)
        ends = 48 + 8 * np.cumsum(sizes)
        parts = [np.frombuffer(self._map, dtype=np.int64, count=n, offset=e - 8 * n) for n, e in zip(sizes, ends)]
        self.keys, self.targets, self.skips, self.ends, self.starts, self.ids = parts

    def find(self, words: Sequence[bytes]) -> np.ndarray:
        """Number of each word in the lexicon, -1 where it is not in it; all words walk side by side."""
        if not words or not len(self.keys):
            return np.full(len(words), -1, dtype=np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        state = np.zeros(len(words), dtype=np.int64)
        number = np.zeros(len(words), dtype=np.int64)
        alive = np.arange(len(words))
        step = 0
        while True:
            alive = alive[lengths[alive] > step]
            if not len(alive):
                break
            wanted = state[alive] << 8 | flat[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            there = self.keys[at] == wanted
            number[alive[~there]] = -1
            lengths[alive[~there]] = 0
            alive, at = alive[there], at[there]
            number[alive] += self.skips[at]
            state[alive] = self.targets[at]
            step += 1
        number[(number >= 0) & (self.ends[state] == 0)] = -1
        number[(number >= 0) & (lengths == 0)] = -1
        return number

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()


_SAFE = re.compile(r"(?<=\S)(?= \S)")
UNSAFE = -2


def chunk_keys(text: str) -> list:
    """Cuts a text at single spaces. A string stands for itself with a space before; a tuple for itself."""
    if not text:
        return []
    if text[0] == " ":
        return whole_chunks(text)
    keys: list = text.split(" ")
    keys[0] = (keys[0],)
    return keys


def whole_chunks(text: str) -> list:
    """The same for a text with runs of white space: only a single space between words is a cut."""
    return [(chunk, None) for chunk in _SAFE.split(text)]


def _unsafe(key: str | tuple) -> bool:
    """Whether a cut beside this chunk may go through a run of white space."""
    if isinstance(key, str):
        return not key or key.strip() != key
    return len(key) == 1 and key[0][-1:].isspace()


def _stretches(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin there and have these sizes, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begin - ends + sizes, sizes) + np.arange(int(sizes.sum()))]


class Encoder:
    """Ids of texts. Chunks seen before are remembered, up to a bound, then forgotten together."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self._forget()

    def _forget(self) -> None:
        self.known: dict = defaultdict(count().__next__)  # numbers chunks as they come
        self.flat = array("i")
        self.begins, self.sizes = array("q"), array("q")  # of each chunk's ids in ``flat``

    def _cut(self, keys: list[str]) -> tuple[list[str | int], np.ndarray]:
        """(pieces of these chunks one after another, how many each has)."""
        pieces = self.vocabulary.pieces(" " + " ".join(keys)) if keys else []
        # each chunk begins with the only piece in it that starts with a space
        firsts = np.flatnonzero(np.fromiter((isinstance(p, str) and p[0] == " " for p in pieces), bool, len(pieces)))
        if len(firsts) == len(keys):
            return pieces, np.diff(firsts, append=len(pieces))
        cut = [self.vocabulary.pieces(" " + key) for key in keys]  # a special token has a space in it
        return list(chain.from_iterable(cut)), np.fromiter(map(len, cut), np.int64, len(cut))

    def _ids_of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these words one after another, how many each has)."""
        found = self.lexicon.find(words) if self.lexicon else np.full(len(words), -1)
        there = found >= 0
        lists = self.vocabulary.merge_many([words[i] for i in np.flatnonzero(~there).tolist()])
        merged = np.fromiter(chain.from_iterable(lists), np.int64)
        begin, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        sizes[~there] = np.fromiter(map(len, lists), np.int64, len(lists))
        begin[~there] = np.cumsum(sizes[~there]) - sizes[~there]
        if self.lexicon:
            starts = self.lexicon.starts
            sizes[there] = starts[found[there] + 1] - starts[found[there]]
            begin[there] = len(merged) + starts[found[there]]
            merged = np.concatenate([merged, self.lexicon.ids])
        return _stretches(merged, begin, sizes), sizes

    def _learn(self, before: int) -> None:
        """Finds the ids of all chunks but the first ``before`` known."""
        keys = list(islice(reversed(self.known), len(self.known) - before))[::-1]
        if not keys:
            return
        unsafe = np.fromiter(map(_unsafe, keys), bool, len(keys))
        whole = np.fromiter((isinstance(key, tuple) for key in keys), bool, len(keys))
        inner, outer = np.flatnonzero(~unsafe & ~whole), np.flatnonzero(~unsafe & whole)
        pieces, counts = self._cut([keys[i] for i in inner.tolist()])
        cut = [self.vocabulary.pieces(keys[i][0]) for i in outer.tolist()]
        pieces.extend(chain.from_iterable(cut))
        counts = np.concatenate([counts, np.fromiter(map(len, cut), np.int64, len(cut))])

        number: dict[str | int, int] = defaultdict(count().__next__)
        numbers = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        is_id = np.fromiter((isinstance(piece, int) for piece in number), bool, len(number))
        ids, sizes_of = self._ids_of_words([piece.encode() for piece in number if isinstance(piece, str)])
        size, begin = np.ones(len(number), np.int64), np.zeros(len(number), np.int64)
        size[~is_id] = sizes_of
        begin[~is_id] = np.cumsum(sizes_of) - sizes_of
        begin[is_id] = len(ids) + np.arange(int(is_id.sum()))
        ids = np.concatenate([ids, np.array([piece for piece in number if isinstance(piece, int)], dtype=np.int64)])

        ends = np.cumsum(np.concatenate([[0], size[numbers]]))[np.cumsum(np.concatenate([[0], counts]))]
        places = np.concatenate([inner, outer])
        begins, sizes = np.zeros(len(keys), np.int64), np.full(len(keys), UNSAFE)
        begins[places], sizes[places] = len(self.flat) + ends[:-1], np.diff(ends)
        self.flat.frombytes(_stretches(ids, begin[numbers], size[numbers]).astype(np.int32).tobytes())
        self.begins.frombytes(begins.tobytes())
        self.sizes.frombytes(sizes.tobytes())

    def _numbers(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, keys), np.int32, len(keys))

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids start and the end)."""
        before = len(self.known)
        numbers = [self._numbers(chunk_keys(text)) for text in texts]
        self._learn(before)
        sizes = np.array(self.sizes, dtype=np.int64)
        unsafe = [i for i, part in enumerate(numbers) if (sizes[part] == UNSAFE).any()]
        if unsafe:
            before = len(self.known)
            for i in unsafe:
                numbers[i] = self._numbers(whole_chunks(texts[i]))
            self._learn(before)
            sizes = np.array(self.sizes, dtype=np.int64)
        chunks = np.concatenate([np.zeros(0, np.int32), *numbers])
        ends = np.cumsum(np.concatenate([[0], sizes[chunks]]))
        per_text = np.cumsum([0, *map(len, numbers)])
        ids = _stretches(np.array(self.flat, dtype=np.int32), np.array(self.begins, dtype=np.int64)[chunks], sizes[chunks])
        if len(self.known) > REMEMBERED:
            self._forget()
        return ids, ends[per_text]


def word_counts(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """Counts of frequent chunks over all texts: ``chunk, n``.

    Each task counts every chunk it reads and passes on those that make up at least
    one in ``2 * words`` of its chunks, so at most ``2 * words`` rows leave a task.
    While it counts, it forgets chunks seen once whenever too many are open.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        total = 0
        for part in chain.from_iterable(slices(batch, 0, TEXTS_AT_ONCE, BYTES_AT_ONCE) for batch in batches):
            for text in part.column(0).to_pylist():
                keys = text.split(" ")
                total += len(keys)
                seen.update(keys)
                if len(seen) > COUNTED_AT_ONCE:
                    seen = Counter({k: n for k, n in seen.items() if n > 1})
        least = max(2, total / (2 * words))
        kept = [(k, n) for k, n in seen.items() if n >= least]
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array([k for k, _ in kept], pa.string()), "n": pa.array([n for _, n in kept], pa.int64())}
        )
        del seen, kept
        give_back()

    found = docs.select(body(text_col).alias("text")).mapInArrow(add_up, "chunk string, n long")
    return found.groupBy("chunk").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """Compiled lexicon of the ``words`` most frequent chunks' words; the bound is the parameter."""
    top = word_counts(docs, text_col, words).orderBy(F.desc("n"), "chunk").limit(words).collect()
    entries: dict[bytes, list[int]] = {}
    for row in top:
        if row.chunk and not row.chunk[0].isspace():
            for piece in vocabulary.pieces(" " + row.chunk):
                if isinstance(piece, str):
                    entries[piece.encode()] = ()
    return compile_lexicon(dict(zip(entries, vocabulary.merge_many(list(entries)))))


def encode_documents(
    docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS
) -> DataFrame:
    """``doc_id, ids`` for each row, as the library encodes the whole text without adding special tokens.

    NULL and empty texts have no ids; repeated rows repeat; an empty table gives no
    rows; other columns are not read. ``tokenizer_json`` is the content of the
    vocabulary file; with the lexicon, which is bounded by ``words``, it is broadcast.
    """
    context = docs.sparkSession.sparkContext
    block = build_lexicon(docs, Vocabulary(tokenizer_json), text_col, words)
    shared = context.broadcast((tokenizer_json, block))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            if encoder is None:
                content, compiled = shared.value
                encoder = Encoder(Vocabulary(content), Lexicon(compiled))
                give_back()
            for part in slices(batch, 1, TEXTS_AT_ONCE, BYTES_AT_ONCE):
                ids, bounds = encoder.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])
        del encoder
        give_back()

    chosen = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text"))
    return chosen.mapInArrow(encode, f"doc_id {chosen.schema[0].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """``doc_id, ids, text`` from ``doc_id, ids``: special tokens are written out, bytes that are no UTF-8 replaced.

    NULL ids give an empty text; ids outside the vocabulary stand for nothing.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer_json)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = starts = None
        for batch in batches:
            if starts is None:
                known = Vocabulary(shared.value).bytes_of
                words = [known.get(i, b"") for i in range(max(known) + 1)] + [b""]
                starts = np.cumsum([0, *map(len, words)])
                flat = np.frombuffer(b"".join(words), dtype=np.uint8)
                del known, words
                give_back()
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lists = part.column(1)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ids[(ids < 0) | (ids >= len(starts) - 1)] = len(starts) - 2
                sizes = (starts[1:] - starts[:-1])[ids]
                ends = np.cumsum(sizes)
                total = int(ends[-1]) if len(ids) else 0
                raw = flat[np.repeat(starts[:-1][ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()
                per_doc = np.cumsum([0, *(n or 0 for n in lists.value_lengths().to_pylist())])
                bounds = np.concatenate([[0], ends])[per_doc].tolist()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"]
                )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, ids array<int>, text string")


def default_vocabulary() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def op6_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = default_vocabulary()
    decoded = decode_documents(encode_documents(table(spark, sf_dir, "documents"), content), content)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
