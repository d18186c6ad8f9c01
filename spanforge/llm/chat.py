"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable. A conversation that doesn't end with an assistant turn also gives a last example with nothing to train on, so that no turn is lost.

A turn is written as

    <|role:role|>
    text<|end|>

Control strings inside roles and texts are escaped by one backslash after their first character. A control string that has backslashes there already gets one more, so that removing one from each restores the original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

END = "<|end|>"
#: First character, and what may follow it, of the strings that are escaped. Besides this template's own marks, common templates' marks are, so that their tokenizers don't take a text for a mark.
CONTROLS = (("<", (r"\|", r"/?s>", r"</?SYS>>")), (r"\[", (r"/?INST\]",)), (r"\|", (">",)))
_ANY = "|".join(f"(?<={first})(?=\\\\*(?:{'|'.join(rest)}))" for first, rest in CONTROLS)
_ESCAPED = "|".join(f"(?<={first})\\\\(?=\\\\*(?:{'|'.join(rest)}))" for first, rest in CONTROLS)


def escape(col: Column) -> Column:
    return F.regexp_replace(col, F.lit(_ANY), F.lit(r"\\"))


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, F.lit(_ESCAPED), F.lit(""))


def segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|role:"), escape(role), F.lit("|>\n"), escape(text), F.lit(END))


def header_length(role: Column) -> Column:
    return F.length(escape(role)) + F.lit(10)


def expand(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, target, formatted, loss_start, loss_stop), a row for each example; target is the number of turns before the trained one.

    loss_start and loss_stop are the code points of the trained text in formatted, equal where nothing is trained. Turns go by their number, then role and text, so that tied numbers and repeated rows have one order; a null number comes first. Null roles and texts are empty; only the role "assistant" is trained. Rows of a null conversation form one conversation. Other columns are not read.
    """
    clean = conversations.select(F.col(conv).alias("c"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    turns = clean.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = turns.select("c", F.transform("turns", lambda t: F.struct(segment(t["role"], t["text"]).alias("s"), (t["role"] == "assistant").alias("a"), header_length(t["role"]).alias("h"))).alias("parts"))
    spots = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.get(F.col("parts"), i)["a"] | (i == F.size("parts") - 1))
    each = parts.select("c", "parts", F.explode(spots).alias("i"))
    formatted = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("i") + 1), lambda p: p["s"]), "")
    last = F.get(F.col("parts"), F.col("i"))
    out = each.select("c", "i", formatted.alias("f"), F.length(last["s"]).alias("n"), last["a"].alias("a"), last["h"].alias("h"))
    stop = F.length("f") - F.lit(len(END))
    return out.select(
        F.col("c").alias(conv),
        F.col("i").cast("long").alias("target"),
        F.col("f").alias("formatted"),
        F.when(F.col("a"), F.length("f") - F.col("n") + F.col("h")).otherwise(stop).cast("long").alias("loss_start"),
        stop.cast("long").alias("loss_stop"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted example, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        cut = F.locate("|>\n", x)
        return F.struct(unescape(F.substring(x, F.lit(8), cut - 8)).alias("role"), unescape(F.substring(x, cut + 3, F.length(x))).alias("text"))

    return F.transform(pieces, turn)


def digest(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the examples of each conversation hold, read back from their text and masks."""
    trained = F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_stop") - F.col("loss_start")).cast("int"))
    rows = examples.select(F.col(conv).alias("c"), "target", "formatted", F.when(F.col("loss_stop") > F.col("loss_start"), unescape(trained)).otherwise("").alias("loss"))
    whole = rows.groupBy("c").agg(
        F.max_by("formatted", "target").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    turns = whole.select("c", "loss", "formatted_chars", parse(F.col("longest")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(F.col("c").alias(conv), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")


PLANTED = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    given = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{PLANTED}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{PLANTED}'")
    return digest(expand(given.unionByName(extra)))


# Escaping adds one character for each control string; the marks of a turn are 7 + 3 + 7 characters besides its role.
SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 17 + length(role) + length(text)
    + len(regexp_extract_all(text, '<\\*\|')) + len(regexp_extract_all(text, '<\\*/?s>')) + len(regexp_extract_all(text, '<\\*</?SYS>>'))
    + len(regexp_extract_all(text, '\[\\*/?INST\]')) + len(regexp_extract_all(text, '\|\\*>')) AS n,
    row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS turns
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), prefix AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS chars FROM sized
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (role = 'assistant' OR place = turns) AS BIGINT) AS formatted_chars
FROM prefix GROUP BY conv_id
"""
