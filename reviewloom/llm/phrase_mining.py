"""Collocations: phrases whose words come together more often than their parts suggest.

Every place of a text points to a suffix of words. Each task merges its equal suffixes, cut
at the longest phrase, and routes them by their two leading words; the few pairs that hold
too much for one bucket are routed by all words of the suffix. A bucket sorts its pointers by
multikey three-way quicksort, all open partitions side by side. The size of a partition
that is equal in its first words is the count of that phrase. Partitions below the least
count are given up at once, as no phrase in them can reach it.
"""

from __future__ import annotations

import pickle
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.llm.common import body, keep, share, slices, table
from reviewloom.llm.words import Words, cut_words
from reviewloom.operators.lookup import lookup_join

LONGEST = 3
LEAST = 10
INSIDE_PERCENT = 50
TOP = 2000
BUCKET_BYTES = 24_000_000  # of text, about four million words
BATCH_BYTES = 1 << 22
# Characters that end a piece of text, and those between words
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
SPACES = b"\x20\x09"
END = -1


def frequent_prefixes(
    keys: np.ndarray, weight: np.ndarray, least: int, least_whole: int | None = None
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(words, pointers, counts): one pointer for each prefix of at least ``least`` suffixes, by length.

    ``keys`` has one suffix per row, ``END`` behind its last word, ``weight`` how often each
    occurs. Multikey three-way quicksort: a partition is split by a pivot at its depth into
    smaller, equal and larger ones; the equal one is a phrase and goes on one word deeper.
    ``least_whole`` may ask more of prefixes of full length.
    """
    depths = keys.shape[1]
    order = np.arange(len(keys))
    starts = np.zeros(min(1, len(keys)), dtype=np.int64)
    depth = np.zeros(len(starts), dtype=np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    while len(order):
        sizes = np.diff(np.append(starts, len(order)))
        part_of = np.repeat(np.arange(len(starts)), sizes)
        value = keys[order, depth[part_of]]
        pivot = keys[order[starts + sizes // 2], depth]
        mine = pivot[part_of]
        side = (value >= mine).astype(np.int64) + (value > mine)  # smaller, equal, larger
        target = 3 * part_of + side
        held = np.bincount(target, minlength=3 * len(starts))
        total = np.bincount(target, weights=weight[order], minlength=3 * len(starts)).astype(np.int64)
        begin = np.cumsum(held) - held
        moved, labels = np.empty_like(order), np.empty_like(target)
        for s in range(3):
            at = np.flatnonzero(side == s)
            own = held[s::3]
            place = (begin[s::3] - (np.cumsum(own) - own))[part_of[at]] + np.arange(len(at))
            moved[place], labels[place] = order[at], target[at]
        goes_on = (held > 0) & (total >= least)
        reached = depth + 1
        equal = np.flatnonzero(goes_on[1::3] & (pivot != END))
        phrases = equal if least_whole is None else equal[(reached[equal] < depths) | (total[1::3][equal] >= least_whole)]
        found.append((reached[phrases], moved[begin[1::3][phrases]], total[1::3][phrases]))
        goes_on[1::3] &= (pivot != END) & (reached < depths)
        order = moved[goes_on[labels]]
        left = held[goes_on]
        starts = np.cumsum(left) - left
        depth = np.repeat(depth, 3)[goes_on]
        depth[np.flatnonzero(goes_on) % 3 == 1] += 1
    if not found:
        return []
    size, pointer, count = (np.concatenate(column) for column in zip(*found))
    return [(d, pointer[size == d], count[size == d]) for d in range(1, depths + 1) if (size == d).any()]


def merge_equal(suffixes: np.ndarray, *before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of different suffixes, in order of ``before`` and their words."""
    columns = [*before, *suffixes.T]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for column in columns:
        ranked = column[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    firsts = np.flatnonzero(new)
    return order[firsts], np.diff(np.append(firsts, len(order)))


def _pack(data: np.ndarray | bytes) -> bytes:
    """Whole numbers in as few bytes as the largest needs, or plain bytes; compressed."""
    if isinstance(data, bytes):
        width, raw = 0, data
    else:
        kind = np.min_scalar_type(int(data.max(initial=0)))
        width, raw = kind.itemsize, data.astype(kind).tobytes()
    return struct.pack("<BQ", width, len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(block: bytes) -> np.ndarray | bytes:
    width, size = struct.unpack_from("<BQ", block)
    raw = pa.decompress(block[9:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, dtype=f"<u{width}").astype(np.int64) if width else raw


def _suffixes(cut: Words, longest: int) -> np.ndarray:
    """The next ``longest`` words at each place, ``END`` behind the end of the piece."""
    n = len(cut.codes)
    out = np.full((n, longest), END, dtype=np.int32)
    for k in range(longest):
        same = np.flatnonzero(cut.piece[: max(0, n - k)] == cut.piece[k:])
        out[same, k] = cut.codes[same + k]
    return out


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, pa.Array]]:
    for part in slices(batch, 1, rows=1 << 14, size=BATCH_BYTES):
        cut = cut_words(part.column(1), SPACES, BREAKS, lower=True)
        langs = part.column(0).dictionary_encode()
        yield cut, langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[cut.text], langs.dictionary


def _words_and_pairs(chosen: DataFrame, share_of: int) -> DataFrame:
    """``lang, phrase, size, n``: words, and pairs that make up one in ``2 * share_of`` places of a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut, lang, langs in _cut(batch):
                suffixes = _suffixes(cut, 2)
                at, n = merge_equal(suffixes[:, :1], lang)
                pairs = np.flatnonzero(suffixes[:, 1] != END)
                two, m = merge_equal(suffixes[pairs], lang[pairs])
                two, m = pairs[two[m * 2 * share_of >= len(pairs)]], m[m * 2 * share_of >= len(pairs)]
                words = cut.known.take(pa.array(suffixes[at, 0]))
                first, second = (cut.known.take(pa.array(suffixes[two, k])) for k in (0, 1))
                joined = pc.binary_join_element_wise(first, second, b" ")
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.take(pa.array(np.concatenate([lang[at], lang[two]]))),
                        pa.concat_arrays([words, joined]).cast(pa.string()),
                        pa.array(np.repeat([1, 2], [len(at), len(two)]).astype(np.int32)),
                        pa.array(np.concatenate([n, m])),
                    ],
                    ["lang", "phrase", "size", "n"],
                )

    counted = chosen.mapInArrow(count, "lang string, phrase string, size int, n long")
    return counted.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def _routed(chosen: DataFrame, hot_pairs, buckets: int, longest: int) -> DataFrame:
    """``lang, bucket, hot, words, suffixes, counts``: different suffixes of each batch, packed by bucket.

    A suffix lists its words by their number among ``words``, from 1, and 0 behind its end.
    """

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = None
        for batch in batches:
            hot = pickle.loads(hot_pairs.value) if hot is None else hot
            for cut, lang, langs in _cut(batch):
                suffixes = _suffixes(cut, longest)
                places = np.flatnonzero(suffixes[:, 1] != END)
                # words are renumbered by name, so that those of a bucket pack well
                by_name = pc.sort_indices(cut.known).to_numpy()
                rank = np.full(len(by_name) + 1, END, dtype=np.int32)
                rank[by_name] = np.arange(len(by_name))
                suffixes = rank[suffixes[places]]
                at, counts = merge_equal(suffixes, lang[places])
                suffixes, lang = suffixes[at], lang[places[at]]
                known = cut.known.take(pa.array(by_name)).to_pylist()
                digest = np.array([*map(zlib.crc32, known), 0], dtype=np.uint64)  # END takes the last one
                number = {word: i for i, word in enumerate(known)} if hot else {}
                names = {name: i for i, name in enumerate(langs.to_pylist())}
                pairs = [
                    (names[name] * len(known) + number[a]) * len(known) + number[b]
                    for name, a, b in hot
                    if name in names and a in number and b in number
                ]
                is_hot = np.isin((lang * len(known) + suffixes[:, 0]) * len(known) + suffixes[:, 1], pairs)
                mixed = np.zeros(len(lang), dtype=np.uint64)
                for k in range(longest):
                    word = digest[suffixes[:, k]]
                    mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (word if k < 2 else np.where(is_hot, word, 0))
                bucket = ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)
                group = (lang * buckets + bucket) * 2 + is_hot
                order = np.argsort(group, kind="stable")
                suffixes, counts, group = suffixes[order], counts[order], group[order]
                firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
                blocks = []
                for a, b in zip(firsts, np.append(firsts[1:], len(group))):
                    used, local = np.unique(suffixes[a:b].T, return_inverse=True)  # by word, then suffix
                    ended = int(used[0] == END)
                    words = b"\n".join(known[i] for i in used[ended:].tolist())
                    blocks.append((_pack(words), _pack(local.ravel() + 1 - ended), _pack(counts[a:b])))
                heads = group[firsts]
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.take(pa.array(heads // (2 * buckets))),
                        pa.array(heads // 2 % buckets),
                        pa.array(heads % 2 == 1),
                        *(pa.array([block[i] for block in blocks], pa.binary()) for i in range(3)),
                    ],
                    ["lang", "bucket", "hot", "words", "suffixes", "counts"],
                )

    return chosen.mapInArrow(
        route, "lang string, bucket long, hot boolean, words binary, suffixes binary, counts binary"
    )


def _sorted_buckets(routed: DataFrame, longest: int, least: int) -> DataFrame:
    """``lang, phrase, size, n`` of frequent phrases of two words or more; parts of counts where the pair is hot."""

    def sort(key: tuple, rows: pa.Table) -> pa.Table:
        lang, _, hot = (value.as_py() for value in key)
        cut = cut_words(pa.array(map(_unpack, rows.column("words").to_pylist()), pa.binary()), b"\n")
        bounds = np.searchsorted(cut.text, np.arange(rows.num_rows + 1))
        keys = np.concatenate(
            [
                np.append(END, cut.codes[a:b]).astype(np.int32)[_unpack(block).reshape(longest, -1).T]
                for a, b, block in zip(bounds, bounds[1:], rows.column("suffixes").to_pylist())
            ]
        )
        counts = np.concatenate([_unpack(block) for block in rows.column("counts").to_pylist()])
        phrases, sizes, totals = [], [], []
        for size, pointer, n in frequent_prefixes(keys, counts, 1 if hot else least, least):
            if size > 1:
                parts = [cut.known.take(pa.array(keys[pointer, k])) for k in range(size)]
                phrases.append(pc.binary_join_element_wise(*parts, b" ").cast(pa.string()))
                sizes.append(np.full(len(n), size, dtype=np.int32))
                totals.append(n)
        many = sum(map(len, totals))
        return pa.table(
            {
                "lang": pa.array([lang] * many, pa.string()),
                "phrase": pa.concat_arrays([pa.array([], pa.string()), *phrases]),
                "size": pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *sizes])),
                "n": pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *totals])),
                "hot": pa.array([hot] * many, pa.bool_()),
            }
        )

    found = routed.groupBy("lang", "bucket", "hot").applyInArrow(
        sort, "lang string, phrase string, size int, n long, hot boolean"
    )
    found = keep(found)
    split = found.filter("hot").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return found.filter("NOT hot").drop("hot").unionByName(split)


def phrase_counts(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    text_col: str = "text",
    lang_col: str = "lang",
    bucket_bytes: int = BUCKET_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(``lang, phrase, size, n`` of phrases of 1 to ``longest`` words found ``least`` times, ``lang, n`` of all words).

    Both are kept. Buckets grow in number with the text; pairs that hold more than about
    a quarter of one, fewer than eight for each, are split by the words behind them.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), body(text_col).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    buckets = max(1, -(-size // bucket_bytes))
    share_of = max(64, 4 * buckets)
    counted = _words_and_pairs(chosen, share_of).persist(StorageLevel.DISK_ONLY)
    totals = keep(counted.filter("size = 1").groupBy("lang").agg(F.sum("n").alias("n")))
    whole = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = keep(counted.filter((F.col("size") == 1) & (F.col("n") >= least)))
    # a pair above one in share_of places is reported for more than half of them
    hot = counted.filter((F.col("size") == 2) & (F.col("n") * 2 * share_of >= whole)).select("lang", "phrase").collect()
    counted.unpersist()
    hot_pairs = share(spark, [(row.lang, *row.phrase.encode().split(b" ")) for row in hot])
    longer = _sorted_buckets(_routed(chosen, hot_pairs, buckets, longest), longest, least)
    return keep(words.unionByName(longer)), totals


def _key(phrase: Column) -> Column:
    return F.concat("lang", F.lit("\n"), phrase)


def mine_phrases(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    inside_percent: int = INSIDE_PERCENT,
    top: int = TOP,
    text_col: str = "text",
    lang_col: str = "lang",
    bucket_bytes: int = BUCKET_BYTES,
    max_bytes: int = 64 * 1024 * 1024,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    A phrase has 2 to ``longest`` words of one piece of text and occurs ``a >= least``
    times. Its score is the lowest of a million times a a / (l r), rounded down, over all
    cuts into a first part found l and a rest found r times; ties go to the earliest cut. A
    phrase inside a longer one that has ``inside_percent`` of its occurrences is dropped.
    Equal scores are ranked by count, then phrase in byte order. Counts below 10**15 are exact.

    A NULL language is ``und``; NULL and empty texts hold no words; repeated rows and
    ids count each time; a text of any length is cut whole, in memory of its own; other
    columns are not read; an empty table gives no rows.
    """
    counts, totals = phrase_counts(docs, longest, least, text_col, lang_col, bucket_bytes)
    held = F.split("phrase", " ")
    phrases = counts.filter("size > 1").withColumn("words", held)
    known = counts.select(_key(F.col("phrase")).alias("key"), "n")

    cuts = phrases.select(
        "lang", "phrase", F.col("n").alias("a"), "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    )
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        _key(F.array_join(F.slice("words", 1, F.col("k")), " ")).alias("first"),
        _key(F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ")).alias("rest"),
    )
    for column, name in (("first", "l"), ("rest", "r")):
        cuts = keep(cuts)  # a large table is looked up in several steps
        cuts = lookup_join(cuts, known.select(F.col("key").alias(column), F.col("n").alias(name)), column, max_bytes=max_bytes)
    exact = {c: f"cast({c} AS DECIMAL(15, 0))" for c in ("a", "l", "r")}
    score = F.expr(f"CAST(1000000 AS DECIMAL(7, 0)) * ({exact['a']} * {exact['a']}) DIV ({exact['l']} * {exact['r']})")
    scored = (
        cuts.withColumn("score", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    )

    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda m: F.transform(
                F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " ")
            ),
        )
    )
    inner = phrases.filter("size > 2").select("lang", F.explode(spans).alias("phrase"), F.col("n").alias("longer"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = scored.join(covered, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))
    )
    order = W.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), F.asc("phrase"))
    ranked = alone.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score"
    )


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), places AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces
), f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS n
  FROM places, (VALUES (1), (2), (3)) AS sizes(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL
), totals AS (
  SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang
), held AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, n AS a FROM f WHERE k > 1 AND n >= 10
), parts AS (
  SELECT lang, phrase, a, c, array_to_string(ws[1:c], ' ') AS head, array_to_string(ws[c + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS c FROM held)
), cuts AS (
  SELECT p.lang, p.phrase, p.a, c, x.n AS l, y.n AS r, (1000000::HUGEINT * p.a * p.a) // (x.n::HUGEINT * y.n) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.head JOIN f y ON y.lang = p.lang AND y.phrase = p.rest
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM held WHERE k = 3
  UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM held WHERE k = 3
), covered AS (
  SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN covered c ON b.lang = c.lang AND b.phrase = c.phrase
  WHERE c.longer IS NULL OR 100 * c.longer < 50 * b.a
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
