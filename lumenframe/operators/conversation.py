"""Message tables (conv_id, turn, role, text): windows, filtering, merging, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .ordered import OrderedRows, Running

# Exchanges kept (two messages each) and the roles a model may see.
MAX_TURNS = 10
CHAT_ROLES = ("user", "assistant")


def last_turns(messages: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """The newest ``2 * max_turns`` messages of every conversation.

    The ranked limit runs inside each task before the shuffle, so a very long conversation sends only its tail.
    """
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return (
        messages.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= 2 * max_turns).drop("__rn")
    )


def chat_text(messages: DataFrame) -> DataFrame:
    """Plain user and assistant messages; rows without text (tool calls) and other roles are left out."""
    return messages.where(F.col("role").isin(*CHAT_ROLES) & F.col("text").isNotNull())


def display_text(messages: DataFrame) -> DataFrame:
    """Every message that is plain text, whatever its role."""
    return messages.where(F.col("text").isNotNull())


def _grouped(islands: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda m: m["text"]
    ), "\n")
    return islands.groupBy("conv_id", "island").agg(
        F.min("turn").alias("turn"), F.first("role").alias("role"), F.count("*").alias("merged"),
        text.alias("text"), F.max_by("text", "turn").alias("last_text"),
    ).drop("island")


def merge_roles(messages: DataFrame, bounded: bool = False) -> DataFrame:
    """Join neighbouring messages of one role with line breaks -> (conv_id, turn, role, merged, text, last_text).

    ``bounded`` says every conversation is short (after ``last_turns``); otherwise the runs are found through
    sorted buckets, so one conversation may hold a third of all messages.
    """
    if bounded:
        order = W.partitionBy("conv_id").orderBy("turn")
        starts = messages.withColumn("start", ~F.lag("role").over(order).eqNullSafe(F.col("role")))
        runs = starts.withColumn("island", F.max(F.when(F.col("start"), F.col("turn"))).over(order))
        return _grouped(runs)
    ordered = OrderedRows(messages, ["turn"], ["conv_id"]).with_previous(previous="role")
    starts = ordered.with_columns({"start": ~F.col("previous").eqNullSafe(F.col("role"))})
    runs = starts.with_running(island=Running("max", F.when(F.col("start"), F.col("turn"))))
    return _grouped(runs.rows().drop("previous", "start"))


def messages_for_model(messages: DataFrame, new_messages: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """Recent chat of every conversation with its new message attached -> (conv_id, turn, role, text).

    Per conversation: nothing usable, or not opening with the user, leaves only the new message; if the user
    spoke last the message is appended unless it is that last message; otherwise it becomes a new turn.
    """
    merged = merge_roles(chat_text(last_turns(messages, max_turns)), bounded=True)
    # After last_turns a conversation has at most 2 * max_turns rows, so these windows are bounded.
    ends = merged.groupBy("conv_id").agg(
        F.min_by("role", "turn").alias("first_role"), F.max("turn").alias("last_turn"),
        F.max_by(F.struct("role", "last_text"), "turn").alias("last"),
    )
    asked = new_messages.select("conv_id", F.col("text").alias("new_text"))
    state = asked.join(ends, "conv_id", "left").withColumn(
        "usable", F.coalesce(F.col("first_role") == "user", F.lit(False))
    )
    user_last = F.col("last.role") == "user"
    repeated = user_last & (F.col("last.last_text") == F.col("new_text"))
    is_last = F.col("turn") == F.col("last_turn")
    kept = merged.join(state.where("usable"), "conv_id").select(
        "conv_id", "turn", "role",
        F.when(is_last & user_last & ~repeated, F.concat_ws("\n", "text", "new_text")).otherwise(F.col("text"))
        .alias("text"),
    )
    added = state.where(~F.col("usable") | ~user_last).select(
        "conv_id", F.when(F.col("usable"), F.col("last_turn") + 1).otherwise(F.lit(0)).cast("bigint").alias("turn"),
        F.lit("user").alias("role"), F.col("new_text").alias("text"),
    )
    return kept.unionByName(added)


def append_messages(messages: DataFrame, new_rows: DataFrame) -> DataFrame:
    """A message table with rows added; turns continue after the last one of each conversation, in sorted buckets, so that
    one conversation may have any number of new rows."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    ordered = OrderedRows(new_rows, ["turn"], ["conv_id"]).with_position("__pos").rows()
    placed = ordered.join(last, "conv_id", "left").select(
        "conv_id", (F.coalesce("last_turn", F.lit(-1)) + 1 + F.col("__pos")).cast("bigint").alias("turn"), "role", "text"
    )
    return messages.select("conv_id", "turn", "role", "text").unionByName(placed)


def record_tool_use(calls: DataFrame) -> DataFrame:
    """(conv_id, turn, name, input, result) -> the two messages of each tool call, contents as JSON."""
    identity = F.concat(F.lit("tool_"), F.col("turn").cast("string"))
    use = F.to_json(F.array(F.struct(
        F.lit("tool_use").alias("type"), identity.alias("id"), F.col("name"), F.col("input")
    )))
    answer = F.to_json(F.array(F.struct(
        F.lit("tool_result").alias("type"), identity.alias("tool_use_id"), F.col("result").alias("content")
    )))
    return calls.select("conv_id", F.inline(F.array(
        F.struct(F.col("turn"), F.lit("assistant").alias("role"), use.alias("content")),
        F.struct((F.col("turn") + 1).alias("turn"), F.lit("user").alias("role"), answer.alias("content")),
    )))


def context_text(profiles: DataFrame, reports: DataFrame, instructions: str = "") -> DataFrame:
    """(table, context): instructions, profile text and, where there is one, the validation summary."""
    joined = profiles.join(reports, "table", "left")
    return joined.select("table", F.concat_ws(
        "\n\n\n", F.when(F.lit(instructions) != "", F.lit(instructions)), "profile", "summary"
    ).alias("context"))
