"""Chat formatting by grammar round trip.

Grammar of the rendered text::

    conversation := turn*
    turn         := "<s>[INST]" flag " " role " [/INST]" body "</s>"
    flag         := "" | "!"          "!": role and body are escaped
    role, body   := any text without a control string

Each turn is rendered plainly and parsed again by the deterministic parser below. If the recovered role and text differ
from the source, or a control string stands inside them, the turn is rendered escaped, and parsed and compared again.
Escaping maps ``\\`` to ``\\e``, ``<`` to ``\\l`` and ``[`` to ``\\b``, so no control string can be left, and is undone
exactly. The whole conversation is then parsed and compared once more; a difference stops the job.

Only built-in expressions are used. A conversation is one output row, so its turns do meet in one task; nothing else is
gathered.

Defined results: null role or text counts as empty; null conversation ids form one conversation; turns with equal
numbers are ordered by role, then text; an empty table gives no conversation; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (BEGIN, END, OPEN, CLOSE)
CONTROL_PATTERN = r"<s>|</s>|\[INST\]|\[/INST\]"
TURN_PATTERN = r"(?s)^<s>\[INST\](!?) (.*?) \[/INST\](.*)$"


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\e"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (("[", "\\b"), ("<", "\\l"), ("\\", "\\e")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def header(role: Column, flag: str) -> Column:
    return F.concat(F.lit(f"{BEGIN}{OPEN}{flag} "), role, F.lit(f" {CLOSE}"))


def parse_turn(turn: Column) -> Column:
    """A turn without its end mark to struct(role, text, escaped); role and text are null if it isn't in the grammar."""
    flag, role, body = (F.regexp_extract(turn, TURN_PATTERN, k) for k in (1, 2, 3))
    sound = turn.rlike(TURN_PATTERN) & ~F.concat_ws("\n", role, body).rlike(CONTROL_PATTERN)
    escaped = flag == "!"
    back = lambda x: F.when(sound, F.when(escaped, unescape(x)).otherwise(x))
    return F.struct(back(role).alias("role"), back(body).alias("text"), escaped.alias("escaped"))


def parse(formatted: Column) -> Column:
    """A rendered conversation to the array of its turns."""
    pieces = F.split(formatted, END, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parse_turn)


def render(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length in characters, and whether escaped)."""
    source = conversations.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    plain = F.concat(header(F.col("role"), ""), F.col("text"), F.lit(END))
    first = F.split(plain, END, -1)
    read = parse_turn(first[0])
    same = (F.size(first) == 2) & read["role"].eqNullSafe(F.col("role")) & read["text"].eqNullSafe(F.col("text"))
    turns = (
        source.withColumn("same", same)
        .withColumn("head", F.when(F.col("same"), header(F.col("role"), "")).otherwise(header(escape(F.col("role")), "!")))
        .withColumn("body", F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text"))))
        .withColumn("piece", F.concat("head", "body", F.lit(END)))
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    place = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0).cast("long"))).withColumn("k", F.row_number().over(place))
    span = F.struct(
        (F.col("at") + F.length("head")).alias("start"),
        F.length("body").cast("long").alias("length"),
        (~F.col("same")).alias("escaped"),
    )
    grouped = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "role", "text", "piece", F.when(F.col("role") == "assistant", span).alias("span")))).alias("turns")
    )
    formatted = F.array_join(F.transform("turns", lambda t: t["piece"]), "")
    wanted = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rendered = grouped.select("conv_id", formatted.alias("formatted"), wanted.alias("wanted"), F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"))
    recovered = F.transform(parse(F.col("formatted")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    checked = F.when(recovered.eqNullSafe(F.col("wanted")), F.col("formatted")).otherwise(F.raise_error(F.lit("a rendered conversation does not parse back to its turns")))
    return rendered.select("conv_id", checked.alias("formatted"), "loss_spans")


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of what the rendered text holds, taken from the text and the loss mask alone."""
    turns = parse(F.col("formatted"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.transform(
        "loss_spans",
        lambda s: F.struct(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")).alias("text"), s["escaped"].alias("escaped")),
    )
    loss = F.array_join(F.transform(under, lambda s: F.when(s["escaped"], unescape(s["text"])).otherwise(s["text"])), "")
    return (
        rendered.withColumn("turns", turns)
        .withColumn("loss", loss)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(listed, 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def hard_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are made of control strings."""
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
