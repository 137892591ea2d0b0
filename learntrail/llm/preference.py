"""Preference formatting of conversation pairs with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learntrail.llm.common import table


def _turn(role: Column, text: Column) -> Column:
    """Role and text of a turn; nulls are 'unknown' and empty, and the marker's opening inside a text is parted."""
    return F.struct(F.coalesce(role.cast("string"), F.lit("unknown")).alias("role"), F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    """Run lengths in code points, ``length:1`` where the loss counts: the assistant's words and the line end after them."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.length(_head(t)).cast("string"), F.lit(":0,"), (F.length(t["text"]) + 1).cast("string"), F.when(t["role"] == "assistant", ":1").otherwise(":0"))), ",")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pair_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask`` for rows ``pair_id, chosen, rejected``.

    ``chosen`` and ``rejected`` are arrays of structs (role, text). Their longest common prefix of turns is rendered once as the
    prompt; the rest of each is its completion, with a mask of run lengths. Null arrays are empty; equal conversations give two
    empty completions; repeated rows are kept; other columns are not read. No shuffle.
    """
    clean = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<role:string,text:string>>")), lambda t: _turn(t["role"], t["text"]))
    df = pairs.select("pair_id", clean("chosen").alias("c"), clean("rejected").alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.slice("c", 1, least), lambda t, i: (t["role"] == F.get("r", i)["role"]) & (t["text"] == F.get("r", i)["text"]))
    first = F.array_position(same, F.lit(False))
    df = df.withColumn("n", F.when(first == 0, least).otherwise(first - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    return df.select("pair_id", F.col("n").cast("long").alias("n_common"), _rendered(F.slice("c", 1, F.col("n"))).alias("prompt"), _rendered(rest("c")).alias("chosen"), _mask(rest("c")).alias("chosen_mask"), _rendered(rest("r")).alias("rejected"), _mask(rest("r")).alias("rejected_mask"))


def reply_swaps(conversations: DataFrame) -> DataFrame:
    """Pairs from a table of turns: a conversation up to its last assistant turn, against the same with the last assistant
    reply of its neighbour (the conversation whose id differs in the lowest bit; an empty reply if it has none).

    Conversations without an assistant turn give no pair. Turns go by turn, role and text, so repeated turns stay, in a fixed
    order. Rows with a null conv_id are left out. A conversation is one row, as long as its text.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), _turn(F.col("role"), F.col("text")).alias("t")).select("pair_id", "turn", "t.role", "t.text")
    whole = turns.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    spoken = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    whole = whole.withColumn("k", F.array_max(spoken)).where("k IS NOT NULL")
    replies = turns.where("role = 'assistant'").groupBy((F.col("pair_id").bitwiseXOR(F.lit(1))).alias("pair_id")).agg(F.max(F.struct("turn", "text"))["text"].alias("reply"))
    plain = lambda a: F.transform(a, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    swapped = F.concat(plain(F.slice("turns", 1, F.col("k") - 1)), F.array(F.struct(F.lit("assistant").alias("role"), F.coalesce("reply", F.lit("")).alias("text"))))
    return whole.join(replies, "pair_id", "left").select("pair_id", plain(F.slice("turns", 1, F.col("k"))).alias("chosen"), swapped.alias("rejected"))


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(reply_swaps(table(spark, sf_dir, "conversations")))


OP3_SQL = """
WITH t AS (
  SELECT conv_id AS pair_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), replace(coalesce(text, ''), '<|', '< |')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
ends AS (SELECT pair_id, max(n) AS k FROM t WHERE role = 'assistant' GROUP BY pair_id),
reply AS (SELECT e.pair_id, t.text FROM ends e JOIN t ON t.pair_id = e.pair_id AND t.n = e.k),
c AS (SELECT t.pair_id, t.n, t.role, t.text, e.k FROM t JOIN ends e USING (pair_id) WHERE t.n <= e.k),
r AS (SELECT c.pair_id, c.n, c.role, CASE WHEN c.n = c.k THEN coalesce(reply.text, '') ELSE c.text END AS text
      FROM c LEFT JOIN reply ON reply.pair_id = xor(c.pair_id, 1)),
p AS (SELECT c.pair_id, coalesce(min(CASE WHEN c.role <> r.role OR c.text <> r.text THEN c.n END) - 1, max(c.k)) AS n_common
      FROM c JOIN r USING (pair_id, n) GROUP BY c.pair_id),
shown AS (
  SELECT c.pair_id, c.n, c.n <= p.n_common AS common, p.n_common,
         '<|' || c.role || '|>' || chr(10) || c.text || chr(10) AS c_text, '<|' || r.role || '|>' || chr(10) || r.text || chr(10) AS r_text,
         (length(c.role) + 5) || ':0,' || (length(c.text) + 1) || CASE WHEN c.role = 'assistant' THEN ':1' ELSE ':0' END AS c_mask,
         (length(r.role) + 5) || ':0,' || (length(r.text) + 1) || CASE WHEN r.role = 'assistant' THEN ':1' ELSE ':0' END AS r_mask
  FROM c JOIN r USING (pair_id, n) JOIN p USING (pair_id))
SELECT pair_id, CAST(n_common AS BIGINT) AS n_common,
       coalesce(string_agg(c_text, '' ORDER BY n) FILTER (WHERE common), '') AS prompt,
       coalesce(string_agg(c_text, '' ORDER BY n) FILTER (WHERE NOT common), '') AS chosen,
       coalesce(string_agg(c_mask, ',' ORDER BY n) FILTER (WHERE NOT common), '') AS chosen_mask,
       coalesce(string_agg(r_text, '' ORDER BY n) FILTER (WHERE NOT common), '') AS rejected,
       coalesce(string_agg(r_mask, ',' ORDER BY n) FILTER (WHERE NOT common), '') AS rejected_mask
FROM shown GROUP BY pair_id, n_common
"""
