"""Chat formatting in budgeted windows, in built-in expressions.

Prefix sums of turn sizes cut a conversation into spans of whole turns. Each window
holds the system turn, a little history before the span, and the span. Loss falls on
each assistant text once: repeated turns are masked.

Template: ``<|role|>``, newline, text, ``<|end|>``, newline. In roles and texts the
characters ``& < > [`` are written as character references, so neither these control
strings nor those of other templates can appear inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.llm.common import body, table

BUDGET = 1024
HISTORY = 128
# What is written for each special character, the ampersand first
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"))
END = "<|end|>\n"
HEAD_END = "|>\n"


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def turn_size(text: Column) -> Column:
    """Size estimate of a turn in tokens: a quarter of its characters, and four for the template."""
    return F.ceil(F.length(text) / 4).cast("long") + 4


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns with their place, the tokens before them and the span they belong to."""
    ordered = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = ordered.rowsBetween(W.unboundedPreceding, 0)
    base = (
        turns.withColumn("tokens", turn_size(F.col("text")))
        .withColumn("place", F.row_number().over(ordered))
        .withColumn("leads", (F.col("place") == 1) & (F.col("role") == "system"))
        .withColumn("system_tokens", F.first(F.when(F.col("leads"), F.col("tokens")).otherwise(0)).over(upto))
        .withColumn("room", F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(budget // 4)))
        .withColumn("own", F.when(F.col("leads"), 0).otherwise(F.col("tokens")))
        .withColumn("before", F.sum("own").over(upto) - F.col("own"))
    )
    # A span takes the turns that start in one half of the room; a turn above half the
    # room starts a span, and as it covers a half it also ends there.
    half = (F.col("room") / 2).cast("long")
    marked = (
        base.withColumn("block", F.floor(F.col("before") / half))
        .withColumn("large", (F.col("own") > half).cast("int"))
        .withColumn("cuts", F.sum("large").over(upto))
        .withColumn("last_block", F.lag("block").over(ordered))
        .withColumn("last_cuts", F.lag("cuts").over(ordered))
    )
    # the leading system turn lies in the first span, so the turn behind it starts none
    behind = (F.col("place") == 2) & (F.col("system_tokens") > 0)
    moved = (F.col("block") != F.col("last_block")) | (F.col("cuts") != F.col("last_cuts"))
    starts = F.coalesce(moved & ~behind, F.lit(False)).cast("int")
    return marked.withColumn("starts", starts).withColumn("span", F.sum("starts").over(upto))


def chat_windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    """One row per window: ``conv_id, window, n_new, n_repeated, tokens, over_budget, formatted, loss_spans``.

    Turns go by ``turn`` (NULL first), then role and text. NULL roles and texts count
    as empty; NULL conversation ids make one conversation. Repeated rows are turns of
    their own. An empty table gives no rows. Other columns are not read.

    A window holds ``n_repeated`` turns seen before (the system turn, if the first turn
    is one, and turns that start within ``history`` tokens before the span), then
    ``n_new`` turns of its own. ``loss_spans`` are (start, length) in characters of
    ``formatted``: the assistant texts among the new turns. A single turn above the
    room is kept whole in a window of its own, marked ``over_budget``.

    Turns are numbered and summed by window functions, which spill; no conversation is
    collected into one value. ``history`` should not be larger than half of the room.
    """
    turns = conversations.select("conv_id", "turn", body("role").alias("role"), body("text").alias("text"))
    placed = _placed(turns, budget, history)
    near = W.partitionBy("conv_id").orderBy("before").rangeBetween(0, history)
    upto = W.partitionBy("conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    lead = F.first(F.when(F.col("leads"), F.struct("role", "text"))).over(upto)
    seen = placed.withColumn("later", F.collect_list(F.when(F.col("starts") == 1, F.col("span"))).over(near))
    seen = seen.withColumn("system", F.when(F.col("starts") == 1, lead))
    again = F.when(F.col("leads"), F.array().cast("array<bigint>")).otherwise(
        F.filter("later", lambda s: s > F.col("span"))
    )
    lead_part = F.struct(
        F.lit(0).alias("place"), F.lit(False).alias("new"), F.col("system.role").alias("role"), F.col("system.text").alias("text")
    )
    turn_part = F.struct("place", F.lit(True).alias("new"), "role", "text")
    past_part = F.struct("place", F.lit(False).alias("new"), "role", "text")
    entries = F.concat(
        F.array(F.struct(F.col("span").alias("window"), turn_part.alias("part"))),
        F.when(F.col("system").isNotNull(), F.array(F.struct(F.col("span").alias("window"), lead_part.alias("part")))).otherwise(
            F.array()
        ),
        F.transform(again, lambda s: F.struct(s.alias("window"), past_part.alias("part"))),
    )
    rows = seen.select("conv_id", F.explode(entries).alias("e")).select("conv_id", "e.window", "e.part")
    gathered = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("part")).alias("parts"))

    def render(part: Column) -> Column:
        return F.concat(F.lit("<|"), escape(part["role"]), F.lit(HEAD_END), escape(part["text"]), F.lit(END))

    def measure(acc: Column, part: Column) -> Column:
        head = F.length(escape(part["role"])) + len("<|" + HEAD_END)
        size = F.length(escape(part["text"]))
        target = part["new"] & (part["role"] == "assistant")
        span = F.array(F.struct((acc["at"] + head).alias("start"), size.alias("length")))
        return F.struct(
            (acc["at"] + head + size + len(END)).alias("at"),
            F.when(target, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + turn_size(p["text"]))
    return gathered.select(
        "conv_id",
        "window",
        F.size(F.filter("parts", lambda p: p["new"])).cast("long").alias("n_new"),
        F.size(F.filter("parts", lambda p: ~p["new"])).cast("long").alias("n_repeated"),
        total.alias("tokens"),
        (total > budget).alias("over_budget"),
        F.array_join(F.transform("parts", render), "").alias("formatted"),
        F.aggregate("parts", zero, measure, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """The new turns of each window, read back from its text: adds ``turns`` (role, text) and ``targets``."""
    pieces = F.slice(F.split("formatted", r"<\|end\|>\n"), F.col("n_repeated").cast("int") + 1, F.col("n_new").cast("int"))

    def parse(piece: Column) -> Column:
        at = F.instr(piece, HEAD_END)
        role = F.substr(piece, F.lit(3), at - 3)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, at + len(HEAD_END))).alias("text"))

    def cut(span: Column) -> Column:
        return unescape(F.substr(F.col("formatted"), span["start"] + 1, span["length"]))

    return windows.withColumn("turns", F.transform(pieces, parse)).withColumn("targets", F.transform("loss_spans", cut))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, counts and digests of what its windows say. The digest needs the whole conversation in one row."""
    read = read_turns(windows)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    part = F.struct(
        "window", F.array_join(lines, "").alias("turns"), F.array_join("targets", "").alias("loss"), F.col("n_new").alias("n")
    )
    grouped = read.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.sum(F.length("formatted")).alias("formatted_chars")
    )
    loss = F.array_join("parts.loss", "")
    return grouped.select(
        "conv_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + p["n"]).alias("n_turns"),
        F.sha2(F.array_join("parts.turns", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


PROBE = "</s>[INST] ok [/INST]"


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{PROBE}' AS text UNION ALL SELECT -7L, 1L, 'assistant', '{PROBE}'"
    )
    return conversation_digests(chat_windows(given.unionByName(probe)))


_WRITTEN = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;')"

ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')
), sized AS (
  SELECT *, (length(text) + 3) // 4 + 4 AS tokens,
         length({_WRITTEN.format("role")}) + length({_WRITTEN.format("text")}) + {len("<|" + HEAD_END + END)} AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM turns
), led AS (
  SELECT *, place = 1 AND role = 'system' AS leads,
         max(CASE WHEN place = 1 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS system_tokens,
         max(CASE WHEN place = 1 AND role = 'system' THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS system_chars,
         CASE WHEN place = 1 AND role = 'system' THEN 0 ELSE tokens END AS own
  FROM sized
), summed AS (
  SELECT *, greatest({BUDGET - HISTORY} - system_tokens, {BUDGET // 4}) // 2 AS half,
         sum(own) OVER (PARTITION BY conv_id ORDER BY place) - own AS before FROM led
), cut AS (
  SELECT *, before // half AS block,
         sum(CASE WHEN own > half THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY place) AS cuts FROM summed
), started AS (
  SELECT *, CASE WHEN NOT (place = 2 AND system_tokens > 0)
                  AND (block <> lag(block) OVER w OR cuts <> lag(cuts) OVER w) THEN 1 ELSE 0 END AS starts
  FROM cut WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), spans AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY place) AS span FROM started),
repeats AS (
  SELECT t.conv_id, sum(t.chars) AS chars FROM spans t JOIN spans s
    ON s.conv_id = t.conv_id AND s.starts = 1 AND s.span > t.span AND s.before BETWEEN t.before AND t.before + {HISTORY}
  WHERE NOT t.leads GROUP BY t.conv_id
)
SELECT s.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '')) AS loss_sha256,
       CAST(sum(s.chars) + max(system_chars) * max(span) + coalesce(max(r.chars), 0) AS BIGINT) AS formatted_chars
FROM spans s LEFT JOIN repeats r ON r.conv_id = s.conv_id GROUP BY s.conv_id
"""
