"""Near duplicates by fast similarity sketching, banding and exact verification.

A sketch (Dahlgaard, Knudsen and Thorup, 2017) has ``t`` bins. In round ``i`` each
shingle is hashed to one bin with a value in [i, i + 1); a bin keeps its least value.
After ``t`` random rounds, round ``t + j`` sends every shingle to bin ``j``, so every
bin fills; rounds end when all are full. Large sets need one round. Bins then agree
with the similarity of the sets, with the concentration of t independent samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import body, keep, slices, table
from reviewloom.llm.components import components

BANDS = 30
ROWS = 6  # at similarity 0.85 a pair misses all 30 bands of 6 once in a million
WORDS = 5
PER_CENT = 85
TEXTS_AT_ONCE = 256
PARITIES = 16  # words of 64 bits


def text_words(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split()


def shingle_strings(text: str, words: int = WORDS) -> set[bytes]:
    """Distinct runs of ``words`` words; a shorter text is one run, a text without words none."""
    found = text_words(text)
    if len(found) <= words:
        return {b" ".join(found)} if found else set()
    return set(map(b" ".join, zip(*(found[i:] for i in range(words)))))


def similar(inside: int, a: int, b: int, per_cent: int = PER_CENT) -> bool:
    return 100 * inside >= per_cent * (a + b - inside) and inside > 0


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit shingle hashes: ``bins`` 64-bit values.

    A value holds the round in its upper bits, so an earlier round wins.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(bins, empty, dtype=np.uint64)
    for turn in range(2 * bins):
        mixed = _mix(shingles ^ np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = np.uint64(turn) << np.uint64(48) | mixed >> np.uint64(16)
        if turn < bins:
            place = (mixed & np.uint64(0xFFFF)) * np.uint64(bins) >> np.uint64(16)
            least = np.full(bins, empty, dtype=np.uint64)
            np.minimum.at(least, place.astype(np.int64), value)
            out = np.minimum(out, least)
        else:
            out[turn - bins] = min(out[turn - bins], value.min())
        if (out != empty).all():
            break
    return out


def _hashes(words: list[bytes], run: int, known: dict[bytes, int]) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``run`` words; ``known`` remembers word hashes."""
    for word in set(words).difference(known):
        known[word] = xxhash.xxh3_64_intdigest(word)
    single = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    run = min(run, len(words))
    mixed = np.full(len(words) - run + 1, len(words) if run < WORDS else WORDS, dtype=np.uint64)
    for i in range(run):
        mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + single[i : len(words) - run + 1 + i])
    return np.unique(mixed)


def sketch_documents(
    docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS, words: int = WORDS
) -> DataFrame:
    """``doc_id, n_shingles, same, bands``: a digest of the word sequence and one hash per band.

    Both are NULL for a text without words. The sequence digest has 128 bits.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, 1):
                sizes, same, flat, ends = [], [], [], [0]
                for text in part.column(1).to_pylist():
                    found = text_words(text)
                    if not found:
                        sizes.append(0)
                        same.append(None)
                    else:
                        shingles = _hashes(found, words, known)
                        sizes.append(len(shingles))
                        same.append(xxhash.xxh3_128_digest(b" ".join(found)))
                        values = sketch(shingles, bands * rows).reshape(bands, rows)
                        band = np.arange(bands, dtype=np.uint64)
                        for row in range(rows):
                            band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + values[:, row])
                        flat.append(band.astype(np.int64))
                    ends.append(ends[-1] + (bands if found else 0))
                if len(known) > 500_000:
                    known.clear()
                values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), lists],
                    ["doc_id", "n_shingles", "same", "bands"],
                )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    return chosen.mapInArrow(work, "doc_id long, n_shingles long, same binary, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``x, r, inside, n_x, n_r`` for pairs ``x, r``: sizes of their sets of shingles and of what they share.

    Sets of whole words are compared, not hashes. Pairs are grouped by ``r`` in lots of
    bounded size; a lot gets the text of ``r`` once and each ``x`` with its text.
    ``texts`` is ``doc_id, text``.
    """
    counts = pairs.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    lots = F.greatest(F.ceil(F.col("n") / TEXTS_AT_ONCE), F.lit(1)).cast("int")
    lot_of = F.pmod(F.xxhash64("x"), F.col("lots")).cast("int")
    wanted = pairs.join(counts.select("r", lots.alias("lots")), "r").select("x", "r", lot_of.alias("lot"))
    sides = wanted.join(texts, wanted["x"] == texts["doc_id"]).select("r", "lot", "x", "text")
    heads = (
        wanted.select("r", "lot")
        .distinct()
        .join(texts, F.col("r") == texts["doc_id"])
        .select("r", "lot", F.lit(None).cast("long").alias("x"), "text")
    )

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        is_head = rows["x"].isna().to_numpy()
        head = shingle_strings(rows["text"].to_numpy()[is_head][0], words)
        out = []
        for x, text in zip(rows["x"].to_numpy()[~is_head], rows["text"].to_numpy()[~is_head]):
            found = shingle_strings(text, words)
            out.append((int(x), int(key[0]), len(found & head), len(found), len(head)))
        return pd.DataFrame(out, columns=["x", "r", "inside", "n_x", "n_r"])

    both = sides.unionByName(heads)
    return both.groupBy("r", "lot").applyInPandas(compare, "x long, r long, inside long, n_x long, n_r long")


def shingle_rows(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``x, shingle``: the distinct 64-bit shingle hashes of each document in ``texts`` (``doc_id, text``)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, 1, rows=500):
                sets = [_hashes(found, words, known) for found in map(text_words, part.column(1).to_pylist())]
                rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
                if len(known) > 500_000:
                    known.clear()
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(flat)], ["x", "shingle"])

    return texts.select("doc_id", "text").mapInArrow(hashed, "x long, shingle long")


def coverage(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``x, n, shared`` per document: its shingles and how many of them another document here has too.

    Shingles are compared by 64-bit hashes; where two meet by chance, ``shared`` is only
    larger. No two documents share more than the smaller ``shared`` of both.
    """
    each = shingle_rows(texts, words)
    per_shingle = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("x").alias("x"))
    alone = per_shingle.filter("k = 1").groupBy("x").agg(F.count(F.lit(1)).alias("alone"))
    sizes = each.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(alone, "x", "left").select("x", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))


def parities(shingles: np.ndarray) -> np.ndarray:
    """``PARITIES`` 64-bit words: bit i is set where an odd number of the shingles falls to i.

    A shingle in one of two sets and not in the other changes one bit, so the bits in
    which two sets differ are never more than the shingles in which they differ.
    """
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity_rows(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``x, bits``: the parities of each document in ``texts`` (``doc_id, text``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, 1, rows=500):
                bits = [parities(_hashes(found, words, known)) for found in map(text_words, part.column(1).to_pylist())]
                if len(known) > 500_000:
                    known.clear()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits, pa.list_(pa.int64()))], ["x", "bits"])

    return texts.select("doc_id", "text").mapInArrow(work, "x long, bits array<long>")


def prefix_pairs(members: DataFrame, texts: DataFrame, per_cent: int = PER_CENT, words: int = WORDS) -> DataFrame:
    """Pairs ``x, r`` of ``members`` (``x, c``) with different ``c`` that may reach ``per_cent``; none that does is missing.

    The shingles of each document are put in one order for all, rarest first. Sets of n
    and m shingles that share at least o have their first common one among the first
    n - o + 1 and m - o + 1, so documents meet only at those. Shingles that no other
    member has come first, use the places up and meet nobody. Pairs whose sizes, places
    or parities allow fewer than o in common are ruled out inside the join.
    """
    texts = texts.join(members.select(F.col("x").alias("doc_id")), "doc_id", "left_semi")
    each = keep(shingle_rows(texts, words))
    sizes = each.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    met = each.join(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "shingle")
    of_x = Window.partitionBy("x")
    met = met.withColumn("place", F.row_number().over(of_x.orderBy("k", "shingle")) - 1)
    met = met.withColumn("met", F.count(F.lit(1)).over(of_x)).join(sizes, "x")
    alone = F.col("n") - F.col("met")
    placed = met.select("x", "shingle", "n", alone.alias("alone"), (alone + F.col("place")).alias("at"))
    placed = placed.filter(100 * F.col("at") <= (100 - per_cent) * F.col("n"))
    facts = members.select("x", "c").join(parity_rows(texts, words), "x")
    prefixes = keep(placed.join(facts, "x"))
    p, q = prefixes.alias("p"), prefixes.alias("q")
    both = F.col("p.n") + F.col("q.n")
    least = F.ceil(per_cent * both / (100 + per_cent))
    before = F.least(F.col("p.at") - F.col("p.alone"), F.col("q.at") - F.col("q.alone"))
    behind = F.least(F.col("p.n") - F.col("p.at"), F.col("q.n") - F.col("q.at"))
    differ = sum((F.bit_count(F.col("p.bits")[i].bitwiseXOR(F.col("q.bits")[i])) for i in range(PARITIES)), F.lit(0))
    meet = (
        (F.col("p.shingle") == F.col("q.shingle"))
        & (F.col("p.x") > F.col("q.x"))
        & (F.col("p.c") != F.col("q.c"))
        & (behind >= least)
        & (before + behind >= least)
        & (differ <= both - 2 * least)
    )
    return p.join(q, meet).select(F.col("p.x").alias("x"), F.col("q.x").alias("r")).distinct()


def _mixed(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Members (``band, key, x``) with their component ``c``, of buckets that hold more than one."""
    placed = members.join(joined.withColumnRenamed("id", "x"), "x", "left")
    placed = placed.withColumn("c", F.coalesce("component", "x")).drop("component")
    several = placed.groupBy("band", "key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
    return placed.join(several.select("band", "key"), ["band", "key"])


def _link_rest(
    mixed: DataFrame, joined: DataFrame, texts: DataFrame, links: DataFrame, per_cent: int, words: int
) -> DataFrame:
    """``links`` (``a, b``) and those between members of the buckets in ``mixed``, which hold several components."""
    agrees = 100 * F.col("inside") >= per_cent * (F.col("n_x") + F.col("n_r") - F.col("inside"))
    covered = keep(coverage(texts.join(mixed.select(F.col("x").alias("doc_id")).distinct(), "doc_id", "left_semi"), words))
    able = covered.filter(100 * F.col("shared") >= per_cent * F.col("n"))
    open_members = keep(_mixed(mixed.drop("c").join(able, "x"), joined))
    hubs = open_members.groupBy("band", "key").agg(F.max(F.struct(F.col("shared") / F.col("n"), -F.col("x"), "c")).alias("h"))
    hubs = hubs.select("band", "key", (-F.col("h.col2")).alias("hub"), F.col("h.c").alias("hub_c"))
    with_hubs = keep(open_members.join(hubs, ["band", "key"]))
    around = with_hubs.filter("c <> hub_c AND tried <> hub AND tried <> x").select("x", F.col("hub").alias("r")).distinct()
    near_hubs = keep(verify(around, texts, words).filter(agrees).select(F.col("x").alias("a"), F.col("r").alias("b")))
    links = links.unionByName(near_hubs)
    joined = keep(components(links))
    last = keep(_mixed(with_hubs.drop("c", "hub_c"), joined).select("x", "c").distinct())
    if last.isEmpty():
        return links
    rest = prefix_pairs(last, texts, per_cent, words)
    return links.unionByName(verify(rest, texts, words).filter(agrees).select(F.col("x").alias("a"), F.col("r").alias("b")))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_cent: int = PER_CENT,
    bands: int = BANDS,
    rows: int = ROWS,
    words: int = WORDS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row.

    Documents link when 100 times the shared shingles is at least ``per_cent`` times
    all of both. A NULL or empty text, or one of white space, has no shingles and links
    with nothing. Rows with the same id count as one document, whose texts all link;
    NULL ids stay apart and are kept. An empty table gives no rows. Other columns are
    not read. ``docs`` must be a stored table.

    Documents with the same words in the same order form a class, of which one member
    goes on. In each band bucket the members are compared with the smallest one. That
    joins most buckets. Where members of different components remain, those that share
    too few shingles with all others there are done; the others are compared with the
    best covered one. Members that are still apart meet at their rarest shingles, where
    sizes, places and parities rule pairs out (``prefix_pairs``). No comparison that could
    give a link is left out.
    """
    sketches = keep(sketch_documents(docs, id_col, text_col, bands, rows, words))
    known = sketches.filter("same IS NOT NULL AND doc_id IS NOT NULL")
    classes = keep(known.groupBy("same").agg(F.min("doc_id").alias("r"), F.first("bands").alias("bands")))
    alike = known.join(classes.select("same", "r"), "same").select(F.col("doc_id").alias("a"), F.col("r").alias("b"))

    buckets = classes.select(F.col("r").alias("x"), F.posexplode("bands").alias("band", "key"))
    firsts = buckets.groupBy("band", "key").agg(F.min("x").alias("r"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = keep(buckets.join(firsts.drop("n"), ["band", "key"]))
    stars = members.filter("x != r").select("x", "r").distinct()
    involved = members.select(F.col("x").alias("doc_id")).distinct()
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    texts = keep(chosen.join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    near = keep(verify(stars, texts, words))
    agrees = 100 * F.col("inside") >= per_cent * (F.col("n_x") + F.col("n_r") - F.col("inside"))
    links = near.filter(agrees).select(F.col("x").alias("a"), F.col("r").alias("b"))
    joined = keep(components(links))

    # Buckets whose members are not yet in one component: a document can link there only
    # if others there have most of its shingles. The one best covered is tried next
    # with all members, such as the original of edited copies; then the rest by prefixes.
    placed = members.select("band", "key", "x", F.col("r").alias("tried"))
    mixed = keep(_mixed(placed, joined))
    if not mixed.isEmpty():
        links = _link_rest(mixed, joined, texts, links, per_cent, words)
    every = links.unionByName(alike)
    found = components(every)
    placed_docs = sketches.join(found, sketches["doc_id"] == found["id"], "left")
    component = F.coalesce("component", "doc_id")
    return placed_docs.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_cent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id; all columns stay.

    Documents are near copies from a similarity of ``per_cent`` on; see ``near_duplicates``.
    """
    found = near_duplicates(docs, id_col, text_col, per_cent)
    away = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__near_id"))
    return docs.join(away, F.col(id_col) == F.col("__near_id"), "left_anti")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_SETS = """
WORDS AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda w: w <> '') AS w FROM documents
), SHINGLES AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM WORDS
)"""

ORACLE = f"""
WITH RECURSIVE {_SETS},
single AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM SHINGLES),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM single a JOIN single b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(id, other) AS (
  SELECT doc_id, doc_id FROM SHINGLES UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, r.component_id, r.component_id = d.doc_id AS kept
FROM SHINGLES d JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) r ON r.id = d.doc_id
"""
