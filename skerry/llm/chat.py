"""Chat formatting from event logs, in DataFrame operations only.

Logs are partitioned by conversation and message and sorted by sequence; the events of a message fold into
its final text; the messages, in order, are rendered into one text per conversation.

Events: conv_id, msg_id, seq, kind, role, text. Kinds:

* ``message``, ``edit``, ``regenerate``: the text so far is replaced by the event's text;
* ``delta``: the event's text is appended;
* ``delete``: the message goes, unless a later event brings it back.

A message stands where its first event stands. Template, for each turn::

    ### role: text </turn>\\n

Inside roles ``\\ : # <`` become a backslash and a letter; inside texts ``\\``, ``### `` and ``</turn>`` get a
backslash before them. So no text can open or close a turn, and ``read_back`` gives every turn exactly.

Cases: null text or role counts as empty, a null kind as ``message``. Ties in seq fold in the order of kind,
then text; messages with equal seq are ordered by role, then text. A null conversation id is a conversation of its own; null seq comes first. Conversations without messages give no
row, an empty log none at all. Repeated events are events. Extra columns are ignored. A conversation's formatted text is one value, so a conversation must fit in
an executor's memory; its turns are folded and rendered before they are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import read, whole

OPEN, CLOSE = "### ", " </turn>\n"
#: What is escaped inside texts: a backslash, what opens a turn, what closes one.
CONTROL = r"(\\|### |</turn>)"
ESCAPED = r"\\(\\|### |</turn>)"
#: Roles: characters and the letters that stand for them after a backslash; the backslash is first.
ROLE_CODES = (("\\", "\\s"), (":", "\\c"), ("#", "\\h"), ("<", "\\l"))
LEARNED = "assistant"


def _role_out(role: Column) -> Column:
    for plain, code in ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_in(role: Column) -> Column:
    for plain, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def fold(events: DataFrame) -> DataFrame:
    """conv_id, msg_id, seq, role, text: the final messages."""
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    event = F.struct("seq", kind.alias("kind"), whole(F.col("text")).alias("text"), F.col("role").alias("role"))
    log = events.groupBy("conv_id", "msg_id").agg(F.sort_array(F.collect_list(event)).alias("log"))
    log = log.withColumn("start", F.array_max(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i).otherwise(0))))
    log = log.filter(F.get("log", F.size("log") - 1)["kind"] != "delete")
    live = F.slice("log", F.col("start") + 1, F.size("log"))
    text = F.array_join(F.transform(live, lambda e: F.when(e["kind"] == "delete", "").otherwise(e["text"])), "")
    role = F.get(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull()), F.lit(0))
    return log.select("conv_id", "msg_id", F.get("log", F.lit(0))["seq"].alias("seq"), whole(role).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: the text, and for each of its turns whether it is under the loss mask."""
    turn = F.concat(F.lit(OPEN), _role_out(F.col("role")), F.lit(": "), F.regexp_replace("text", CONTROL, r"\\$1"), F.lit(CLOSE))
    turns = messages.select("conv_id", F.struct("seq", "role", "text", turn.alias("turn"), (F.col("role") == LEARNED).alias("loss")).alias("t"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.array_join("t.turn", "").alias("formatted"), F.col("t.loss").alias("loss"))


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    closed = F.split(formatted, r"(?<!\\)</turn>\n")
    turns = F.slice(closed, 1, F.size(closed) - 1)

    def turn(t: Column) -> Column:
        colon = F.locate(":", t)
        return F.struct(
            _role_in(F.substring(t, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1)).alias("role"),
            F.regexp_replace(F.substring(t, colon + 2, F.char_length(t) - colon - 2), ESCAPED, "$1").alias("text"),
        )

    return F.transform(turns, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """What each formatted text holds, read back from it."""
    turns = formatted.withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform(F.filter(F.arrays_zip("turns", "loss"), lambda p: p["loss"]), lambda p: p["turns"]["text"])
    return turns.withColumn("learned", F.array_join(masked, "")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def as_events(turns: DataFrame) -> DataFrame:
    """Stored turns as a log: each row is the only event of a message of its own, so repeated rows all stay."""
    row = F.monotonically_increasing_id().alias("msg_id")
    return turns.select("conv_id", row, F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    stored = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text")
    )
    return digests(format_chats(as_events(stored.unionByName(added))))


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(role) + 2 + length(regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g')) + 9) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
