"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions only.

A logger that stores a conversation after every turn leaves prefixes of longer
conversations. Rolling turn-prefix hashes (a running XOR of position-tagged
turn hashes, two of 64 bits) identify them; an anti-join keeps the conversations
that nothing extends, and only those are rendered.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD = "<|im_start|>"
TAIL = "<|im_end|>\n"


def _turn_hash(seed: int, position: Column) -> Column:
    # xxhash64 skips nulls, so nulls are tagged to differ from empty strings
    return F.xxhash64(F.lit(seed), position, F.col("role").isNull(), F.coalesce("role", F.lit("")),
                      F.col("text").isNull(), F.coalesce("text", F.lit("")))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Turns in order with (k, h1, h2): the number of turns so far and the rolling hash of that prefix."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.withColumn("k", F.row_number().over(order).cast("long"))
    return (placed.withColumn("t1", _turn_hash(1, F.col("k"))).withColumn("t2", _turn_hash(2, F.col("k")))
            .withColumn("h1", F.bit_xor("t1").over(so_far)).withColumn("h2", F.bit_xor("t2").over(so_far)))


def collapse(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_copies) of the maximal conversations.

    Of conversations with equal turns (roles and texts in order) the smallest
    conv_id stays and n_copies counts them; one that is a proper prefix of another goes.
    Turns are ordered by turn, then role, then text (nulls first), so ties
    and repeated rows have one order; a repeated row is a turn of its own.
    """
    # the prefix hashes, not the texts, travel from here on
    hashed = prefix_hashes(_named(turns, conv_col, turn_col, role_col, text_col)).select("conv_id", "k", "h1", "h2")
    last = hashed.groupBy("conv_id").agg(F.max(F.struct("k", "h1", "h2")).alias("end")).select("conv_id", "end.*")
    whole = last.groupBy("k", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    ends = last.select("conv_id", F.col("k").alias("n"))
    proper = hashed.join(ends, "conv_id").where("k < n").select("k", "h1", "h2").distinct()
    return (whole.join(proper, ["k", "h1", "h2"], "left_anti")
            .select("conv_id", F.col("k").alias("n_turns"), "n_copies"))


def _named(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
                        F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text")).where("conv_id is not null")


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Maximal conversations as training text: (conv_id, n_turns, n_copies, text).

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``; a null role becomes ``unknown`` and a
    null text is empty. Rows without a conv_id take no part, an empty table gives
    no rows, other columns are ignored.
    """
    kept = collapse(turns, conv_col, turn_col, role_col, text_col)
    lines = _named(turns, conv_col, turn_col, role_col, text_col).join(kept, "conv_id")
    line = F.concat(F.lit(HEAD), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(TAIL))
    # one conversation is one training text, so its turns meet in one row
    return (lines.groupBy("conv_id", "n_turns", "n_copies")
            .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("turns"))
            .select("conv_id", "n_turns", "n_copies", F.array_join(F.col("turns.line"), "").alias("text")))


ORACLE_SQL = """
WITH placed AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
tagged AS (SELECT *, k || ':' || coalesce('r' || length(role) || role, 'n') || coalesce('t' || length(text) || text, 'n') AS tag FROM placed),
prefixes AS (SELECT conv_id, k, string_agg(tag, '|') OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS p FROM tagged),
sizes AS (SELECT conv_id, max(k) AS n FROM placed GROUP BY conv_id),
whole AS (SELECT p, min(conv_id) AS conv_id, count(*) AS n_copies, max(n) AS n_turns
          FROM prefixes JOIN sizes USING (conv_id) WHERE k = n GROUP BY p),
proper AS (SELECT DISTINCT p FROM prefixes JOIN sizes USING (conv_id) WHERE k < n),
kept AS (SELECT * FROM whole WHERE p NOT IN (SELECT p FROM proper))
SELECT kept.conv_id, n_turns, n_copies,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY k) AS text
FROM kept JOIN placed USING (conv_id) GROUP BY kept.conv_id, n_turns, n_copies
"""
