"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example holds all turns before the reply as context, then the reply, which alone is under the loss mask. A turn is written as

    ### role:
    text
    </turn>

with control strings inside roles and texts escaped by a backslash (and backslashes by another), so that only the template's own
marks are marks and the text can be read back exactly. Only DataFrame functions: one shuffle brings the turns of a conversation
together, its examples are exploded from that row one at a time and read back without a second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role whose texts are trained.
TARGET = "assistant"
#: The template's marks: what opens a turn, ends its head line, and closes it.
OPEN, HEAD, CLOSE = "### ", ":\n", "\n</turn>\n"


def escape(text: Column) -> Column:
    """Text without control strings: a backslash before each backslash, each # that begins ###, and each </turn>."""
    return F.regexp_replace(text, r"\\|#(?=##)|</turn>", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|#|</turn>)", "$1")


def escape_role(role: Column) -> Column:
    """A role on one line: as `escape`, with line feeds as backslash and n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a pair of backslashes is no mark of what follows it, so pairs are set apart while line feeds come back
    pairs = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(pairs, lambda p: F.regexp_replace(F.replace(p, F.lit("\\n"), F.lit("\n")), r"\\(#|</turn>)", "$1")), "\\")


def turn(role: Column, text: Column) -> Column:
    """One formatted turn."""
    return F.concat(F.lit(OPEN), escape_role(role), F.lit(HEAD), escape(text), F.lit(CLOSE))


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, whole) of conversations (conv_id, turn, role, text).

    example numbers the turns of a conversation from 1: one row per assistant turn, `text` all turns up to it, and loss_start to
    loss_end (code points, end exclusive) the reply in it. What follows the last reply is in no context; where a conversation does not
    end with a reply one more row holds all of it and has nothing under the mask (both ends null). `whole` marks the row that holds
    all turns. Rows go by turn, then role and text; null turns come first, null roles and texts are empty, null conv_ids are one
    conversation, repeated rows are turns each. An empty table gives no rows; other columns are ignored. All contexts together grow with
    the square of a conversation's turns; a task holds one conversation and one example of it at a time.
    """
    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"),
            F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("_t"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("_t"), _in_order).alias("_turns"))
    written = turns.select("conv_id", F.transform("_turns", lambda t: t["role"] == TARGET).alias("_targets"),
            F.transform("_turns", lambda t: turn(t["role"], t["text"])).alias("_parts"),
            F.transform("_turns", lambda t: F.char_length(escape(t["text"]))).alias("_sizes"))
    n = F.size("_parts")
    picked = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.element_at("_targets", i))
    each = written.select("conv_id", "_targets", "_parts", "_sizes", F.explode(picked).alias("example"))
    each = each.select("conv_id", "example", F.array_join(F.slice("_parts", F.lit(1), F.col("example")), "").alias("text"),
            F.when(F.element_at("_targets", F.col("example")), F.element_at("_sizes", F.col("example"))).alias("_size"),
            (F.col("example") == F.size("_parts")).alias("whole"))
    end = F.char_length("text") - len(CLOSE)
    return each.select("conv_id", "example", "text", (end - F.col("_size")).alias("loss_start"), F.when(F.col("_size").isNotNull(), end).alias("loss_end"),
            "whole")


def _in_order(a: Column, b: Column) -> Column:
    """Comparison of two turns: by turn (null first), role, text."""
    out = F.lit(0)
    for c in ("text", "role", "turn"):
        x, y = a[c], b[c]
        less = F.coalesce(x < y, x.isNull() & y.isNotNull())
        more = F.coalesce(x > y, y.isNull() & x.isNotNull())
        out = F.when(less, -1).when(more, 1).otherwise(out)
    return out


def turns(text: Column) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    closed = F.split(text, CLOSE, -1)
    heads = F.slice(closed, F.lit(1), F.size(closed) - 1)
    return F.transform(heads, _read)


def _read(part: Column) -> Column:
    stop = F.instr(part, "\n")  # the head line ends there: roles hold no line feed
    role = F.substring(part, F.lit(len(OPEN) + 1), stop - 1 - len(OPEN) - 1)
    body = F.substring(part, stop + 1, F.char_length(part))
    return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each turn),
    loss_chars and loss_sha256 (what lies under the loss masks, unescaped, in order), formatted_chars (of all examples), n_examples."""
    reply = unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    read = F.when(F.col("whole"), turns(F.col("text")))
    said = F.transform(read, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    rows = formatted.select("conv_id", F.struct("example", F.when(F.col("loss_end").isNotNull(), reply).alias("reply")).alias("_e"),
            F.char_length("text").cast("long").alias("_chars"), F.size(read).alias("_n"), F.sha2(F.array_join(said, ""), 256).alias("_sha"), "whole")
    out = rows.groupBy("conv_id").agg(F.max(F.when(F.col("whole"), F.col("_n"))).cast("long").alias("n_turns"), F.max("_sha").alias("turns_sha256"),
            F.array_join(F.transform(F.array_sort(F.collect_list("_e")), lambda e: e["reply"]), "").alias("_loss"),
            F.sum("_chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("_loss").cast("long").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


#: The contract's own conversation, full of control strings.
PROBE_ID, PROBE = -7, r"\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) and the probe's two rows."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise(TARGET)
    return c.unionByName(c.sparkSession.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"),
            F.lit(PROBE).alias("text")))


def _escaped_chars(c: str) -> str:
    """DuckDB: characters that escaping adds to c."""
    marks = rf"len(regexp_extract_all({c}, '\\')) + len(regexp_extract_all({c}, '</turn>'))"
    return f"({marks} + coalesce(list_sum(list_transform(regexp_extract_all({c}, '###+'), lambda x: length(x) - 2)), 0))"


#: DuckDB text of op11's result; a turn's share of formatted_chars counts once for each example that holds it.
SQL = rf"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce("text", '') as body from conversations
    union all select * from (values (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')) as probe),
  t as (select *, row_number() over w as pos, count(*) over (partition by conv_id) as n, length(role) + length(body) + {len(OPEN + HEAD + CLOSE)}
      + {_escaped_chars('role')} + length(role) - length(replace(role, chr(10), '')) + {_escaped_chars('body')} as chars
    from c window w as (partition by conv_id order by turn nulls first, role, body)),
  e as (select *, sum(case when role = 'assistant' or pos = n then 1 else 0 end)
      over (partition by conv_id order by pos rows between current row and unbounded following) as held from t)
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' order by pos)) as turns_sha256,
    cast(coalesce(sum(length(body)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(body, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(chars * held) as bigint) as formatted_chars, count(*) filter (role = 'assistant' or pos = n) as n_examples from e group by conv_id"""
