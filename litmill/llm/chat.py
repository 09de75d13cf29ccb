r"""Chat formatting with typed content parts, as DataFrame functions only.

A turn's content is an array of parts. A visitor walks them in order: text parts are taken over, the others leave a
placeholder in the text and an entry in the conversation's list of attachments, with the number of tokens that the
placeholder stands for. A content is escaped as one string, so nothing can be forged from pieces of several parts. The turns of a conversation are put between marks:

    ### role:
    content
    </turn>

What looks like a mark inside a text is escaped so that it can be read back: ``</turn>`` becomes ``\l/turn>``, ``<|``
becomes ``\l|``, ``### `` becomes ``\h## ``, a colon in a role ``\c``, and a backslash before b, l, h or c ``\b``. No
mark is left in an escaped text and every escape has one reading.

The loss mask is a list of spans of the formatted string, in code points, each with its turn's place: the content of each
assistant turn. Spans come from running sums over a conversation's turns, and are read by their turns, so that the work
grows with a conversation's length and not with its square.

Nulls: null texts and roles count as empty, null parts as none; a null kind is text. Kinds without a rule get a
placeholder without tokens. Rows of one turn are put in the order of role and content; null turns come first. A null
conversation is one of its own. Extra columns are left out, so their names can't clash. An empty table gives no conversation. A conversation is one
string of the result, so its rows meet in one task, however long its texts; rows are rendered before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmill.llm._base import table

PARTS = "array<struct<kind:string,text:string,uri:string,size:bigint>>"
#: Tokens of a part: its size times the first number over the second, rounded up. Sizes: patches, milliseconds, pages.
TOKENS = {"image": (1, 1), "audio": (1, 40), "document": (256, 1)}
HEAD, BODY, TAIL = "### ", ":\n", "\n</turn>\n"
#: What stands for a placeholder's beginning and end, and for a null character of a text, until a content is escaped.
OPEN, CLOSE, NUL = "\0o", "\0c", "\0t"


def escape(text: Column) -> Column:
    kept = F.regexp_replace(text, r"\\([blhc])", r"\\b$1")
    return F.replace(F.replace(F.replace(kept, F.lit("</turn>"), F.lit(r"\l/turn>")), F.lit("<|"), F.lit(r"\l|")), F.lit("### "), F.lit(r"\h## "))


def unescape(text: Column) -> Column:
    for short, long in ((r"\l", "<"), (r"\h", "#"), (r"\c", ":"), (r"\b", "\\")):
        text = F.replace(text, F.lit(short), F.lit(long))
    return text


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(0).cast("bigint").alias("size"))).cast(PARTS)


def _kind(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text"))


def _visit_text(part: Column) -> Column:
    """What a part leaves in the text, before it is escaped."""
    name = F.regexp_replace(_kind(part), "[^A-Za-z0-9_-]", "_")
    return F.when(_kind(part) == "text", F.replace(F.coalesce(part["text"], F.lit("")), F.lit("\0"), F.lit(NUL))).otherwise(F.concat(F.lit(OPEN), name, F.lit(CLOSE)))


def _render(parts: Column) -> Column:
    text = escape(F.array_join(F.transform(parts, _visit_text), ""))
    for short, long in ((OPEN, "<|"), (CLOSE, "|>"), (NUL, "\0")):
        text = F.replace(text, F.lit(short), F.lit(long))
    return text


def _visit_attachment(part: Column) -> Column:
    """What a part that isn't text leaves in the list."""
    tokens = F.lit(0).cast("bigint")
    for kind, (times, per) in TOKENS.items():
        tokens = F.when(part["kind"] == kind, F.ceil(F.coalesce(part["size"], F.lit(0)) * times / per)).otherwise(tokens)
    return F.struct(part["kind"].alias("kind"), part["uri"].alias("uri"), tokens.alias("tokens"))


def format_chat(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv, n_turns, formatted, loss_spans array<struct<start,end,turn>>, attachments array<struct<kind,uri,tokens>>, expanded_tokens."""
    content = F.array_compact(F.coalesce(F.col(parts), F.array().cast(PARTS)))
    who = F.coalesce(F.col(role), F.lit(""))
    # Only rendered strings go through the shuffle.
    rendered = turns.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.concat(F.lit(HEAD), F.replace(escape(who), F.lit(":"), F.lit(r"\c")), F.lit(BODY)).alias("head"),
            _render(content).alias("content"),
            who.isin(*learn).alias("learnt"),
            F.transform(F.filter(content, lambda p: _kind(p) != "text"), _visit_attachment).alias("attachments"),
        ).alias("t"),
    )
    order = [F.col(f"t.{c}").asc_nulls_first() for c in ("turn", "head", "content", "learnt")]
    upto = F.sum(F.length("t.head") + F.length("t.content") + F.lit(len(TAIL))).over(Window.partitionBy("conv").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(*order))
    rendered = rendered.select("conv", "t", (upto - len(TAIL)).cast("int").alias("end"), (place - 1).alias("place"))
    # The same partitioning as the window's: rows don't move again.
    grouped = rendered.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "end", "t"))).alias("turns"))

    def span(x: Column) -> Column:
        return F.struct((x["end"] - F.length(x["t"]["content"])).alias("start"), x["end"].alias("end"), x["place"].alias("turn"))

    attachments = F.flatten(F.transform("turns", lambda x: x["t"]["attachments"]))
    return grouped.select(
        F.col("conv").alias(conv),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["t"]["head"], x["t"]["content"], F.lit(TAIL))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda x: x["t"]["learnt"]), span).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted string; placeholders stay as they are."""
    pieces = F.split(formatted, "\n</turn>\n", -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)  # behind the last mark is nothing

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, ":")
        role = piece.substr(F.lit(len(HEAD) + 1), cut - len(HEAD) - 1)
        return F.struct(unescape(role).alias("role"), unescape(piece.substr(cut + len(BODY), F.length(piece))).alias("text"))

    return F.transform(whole, turn)


def masked_turns(turns: Column, spans: Column) -> Column:
    """The texts under the loss mask, with nothing between, by their turns. turns: a column of what read_back() gives."""
    return F.array_join(F.transform(spans, lambda s: F.get(turns, s["turn"])["text"]), "")


def under_mask(formatted: Column, spans: Column) -> Column:
    """The same by code points; each span is looked for from the start of the string."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["end"] - s["start"]))), "")


#: A conversation that holds the marks themselves.
OWN = r"\### Assistant: </turn> ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(OWN).alias("text"))
    made = format_chat(rows.unionByName(own).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    read = made.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), "loss_spans")
    read = read.select("conv_id", "formatted", "turns", masked_turns(F.col("turns"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)
), escaped AS (
  SELECT *, replace(replace(replace(regexp_replace(text, '\\([blhc])', '\\b\1', 'g'), '</turn>', '\l/turn>'), '<|', '\l|'), '### ', '\h## ') AS e FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(e) + 9) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
