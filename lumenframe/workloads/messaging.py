"""Token budgets and conversation preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, fits_budget, truncate_to_budget
from ..operators import conversation, describe, profile
from ..plans import report, validate as validation
from .registry import query, table


@query("token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query("fits_budget", """SELECT lang, count(*) AS n, count(*) FILTER (length(text) // 4 <= 500) AS fitting FROM documents GROUP BY 1""")
def fits_in_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(fits_budget(F.col("text"), 500)).alias("fitting")
    )


@query("truncate_budget", """SELECT doc_id, CASE WHEN length(text) // 4 <= 100 THEN text
ELSE text[1:400] || chr(10) || '... (truncated to fit context window)' END AS text FROM documents""")
def truncate_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", truncate_to_budget(F.col("text"), 100).alias("text"))


_TURNS = 2


def _recent(turns: int) -> str:
    return f"""(SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
    FROM conversations) WHERE rn <= {2 * turns})"""


@query("last_turns", f"SELECT * FROM {_recent(_TURNS)}")
def last_turns(spark, sf_dir):
    return conversation.last_turns(table(spark, sf_dir, "conversations"), _TURNS)


@query("chat_text", "SELECT * FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL")
def chat_text(spark, sf_dir):
    return conversation.chat_text(table(spark, sf_dir, "conversations"))


@query("display_text", "SELECT * FROM conversations WHERE text IS NOT NULL")
def display_text(spark, sf_dir):
    return conversation.display_text(table(spark, sf_dir, "conversations"))


# Messages seen from the person: what others say merges into one voice.
_VOICES = "(SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, text FROM conversations)"


def _voices(spark, sf_dir):
    role = F.when(F.col("role") == "user", "user").otherwise("assistant")
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"), "text")
    return messages


def _merged(source: str) -> str:
    return f"""(SELECT conv_id, min(turn) AS turn, role, count(*) AS merged, string_agg(text, chr(10) ORDER BY turn) AS text,
    max_by(text, turn) AS last_text FROM (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (
      SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS s
      FROM {source})) GROUP BY conv_id, island, role)"""


@query("merge_roles", f"SELECT * FROM {_merged(_VOICES)}")
def merge_roles(spark, sf_dir):
    return conversation.merge_roles(_voices(spark, sf_dir))


@query("merge_people", f"SELECT * FROM {_merged('(SELECT * FROM conversations WHERE role <> $$assistant$$)')}")
def merge_people(spark, sf_dir):
    """Without the assistant, neighbouring user messages form long runs."""
    return conversation.merge_roles(table(spark, sf_dir, "conversations").where("role <> 'assistant'"))


def _chat(turns: int) -> str:
    return _merged(f"(SELECT * FROM {_recent(turns)} WHERE role IN ('user', 'assistant') AND text IS NOT NULL)")


@query("messages_for_model", f"""WITH m AS (SELECT * FROM {_chat(10)}),
ends AS (SELECT conv_id, min_by(role, turn) AS first_role, max(turn) AS last_turn, max_by(role, turn) AS last_role,
  max_by(last_text, turn) AS last_text FROM m GROUP BY 1),
asked AS (SELECT conv_id, max_by(text, turn) AS new_text FROM conversations WHERE role = 'user' GROUP BY 1),
state AS (SELECT *, coalesce(first_role = 'user', false) AS usable FROM asked LEFT JOIN ends USING (conv_id))
SELECT conv_id, turn, role, CASE WHEN turn = last_turn AND last_role = 'user' AND s.last_text <> new_text
  THEN text || chr(10) || new_text ELSE text END AS text FROM m JOIN state s USING (conv_id) WHERE usable
UNION ALL SELECT conv_id, CASE WHEN usable THEN last_turn + 1 ELSE 0 END, 'user', new_text FROM state
WHERE NOT usable OR last_role <> 'user'""")
def messages_for_model(spark, sf_dir):
    """Each conversation continued with the person's newest message, as the store already holds it."""
    messages = table(spark, sf_dir, "conversations")
    asked = messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return conversation.messages_for_model(messages, asked)


@query("append_messages", """SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'Please go on, conversation ' || conv_id FROM conversations GROUP BY conv_id""")
def append_messages(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations")
    asked = messages.groupBy("conv_id").agg(F.min("turn").alias("turn")).select(
        "conv_id", "turn", F.lit("user").alias("role"),
        F.concat(F.lit("Please go on, conversation "), F.col("conv_id").cast("string")).alias("text"),
    )
    return conversation.append_messages(messages, asked)


@query("tool_records", """SELECT user_id AS conv_id, event_id * 2 AS turn, 'assistant' AS role,
'[{"type":"tool_use","id":"tool_' || event_id * 2 || '","name":"' || event_type || '","input":"'
|| replace(props, '"', chr(92) || '"') || '"}]' AS content FROM events
UNION ALL SELECT user_id, event_id * 2 + 1, 'user', '[{"type":"tool_result","tool_use_id":"tool_' || event_id * 2
|| '","content":"' || event_type || '"}]' FROM events""")
def tool_records(spark, sf_dir):
    """Events as tool calls: what was asked and what came back."""
    calls = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("conv_id"), (F.col("event_id") * 2).alias("turn"), F.col("event_type").alias("name"),
        F.col("props").alias("input"), F.col("event_type").alias("result"),
    )
    return conversation.record_tool_use(calls)


@query("context_text")
def context_text(spark, sf_dir):
    """Profile and validation summary of two tables, one text each."""
    profiles, found = [], []
    for name, key in (("supplier", "s_suppkey"), ("nation", "n_nationkey")):
        source = table(spark, sf_dir, name)
        known = profile.infer_profile(source)
        profiles.append(describe.text_profile(source, known).select(F.lit(name).alias("table"), "ordinal", "line"))
        checked = validation.validate(source, [key], profile=known)
        found.append(checked.select(F.lit(name).alias("table"), "*"))
    lines = profiles[0].unionByName(profiles[1]).groupBy("table").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]  # one line per column
    ), "\n").alias("profile"))
    summaries = report.summary_text(found[0].unionByName(found[1]), ["table"]).select("table", "summary")
    return conversation.context_text(lines, summaries)
