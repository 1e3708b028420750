"""Training data: format detection, validation, reports, and rendering to text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("user", "assistant", "system")
MOST_SAMPLES = 10_000


def record_format(instruction: Column, output: Column, conversations: Column) -> Column:
    return F.when(instruction.isNotNull() & output.isNotNull(), "alpaca").when(conversations.isNotNull(), "conversation").otherwise("unknown")


def dataset_format(df: DataFrame, order: str) -> DataFrame:
    """The format of the first record."""
    return df.agg(F.min_by("format", order).alias("format"))


def alpaca_errors(instruction: Column, input_: Column, output: Column) -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.array_compact(F.array(F.when(blank(instruction), "instruction"), F.when(blank(output), "output")))


def conversation_errors(messages: Column) -> Column:
    """messages array<struct<role, content>>: empty, unknown roles, blank contents."""
    bad_role = F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)))
    blank = F.exists(messages, lambda m: F.coalesce(F.trim(m["content"]), F.lit("")) == "")
    return F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(F.when(bad_role, "role"), F.when(blank, "content"))))


def report(df: DataFrame, order: str, most_errors: int = 10) -> DataFrame:
    """df(order, format, errors array<string>) -> valid, format, samples, failed, first_errors (as 'order: error', the first ten, then a
    mark if there are more). The errors are cut before they are gathered."""
    lines = df.where(F.size("errors") > 0).select(F.col(order).alias("o"), F.concat_ws(": ", F.col(order).cast("string"), F.array_join("errors", ",")).alias("line"))
    first = lines.orderBy("o").limit(most_errors).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "; ").alias("shown"))
    totals = df.agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.size("errors") > 0).alias("failed"), F.min_by("format", order).alias("format"))
    ok = (F.col("failed") == 0) & F.col("samples").between(1, MOST_SAMPLES) & (F.col("format") != "unknown")
    return totals.join(first).select(ok.alias("valid"), "format", "samples", "failed", F.when(F.col("failed") > most_errors, F.concat("shown", F.lit("; ..."))).otherwise(F.coalesce("shown", F.lit(""))).alias("first_errors"))


def alpaca_text(instruction: Column, input_: Column, output: Column) -> Column:
    middle = F.when(F.coalesce(F.trim(input_), F.lit("")) != "", F.concat(F.lit("### Input:\n"), input_, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("### Instruction:\n"), F.coalesce(instruction, F.lit("")), F.lit("\n\n"), middle, F.lit("### Response:\n"), F.coalesce(output, F.lit("")))


def conversation_text(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) -> conv_id, text in order of turns; blank messages and other roles are left out.

    user and human are the same, as are assistant and gpt.
    """
    head = F.when(F.lower("role").isin("user", "human"), "### Human:\n").when(F.lower("role").isin("assistant", "gpt"), "### Assistant:\n")
    lines = messages.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("line", F.concat(head, "text")).where("line IS NOT NULL")
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n\n").alias("text"))


def history_summary(history: DataFrame, last: int = 4, head: int = 100) -> DataFrame:
    """history(conv_id, turn, role, text) -> conv_id, summary: the last messages, `head` characters and a mark of each that is longer,
    oldest first."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    cut = F.concat(F.substring("text", 1, head), F.when(F.length("text") > head, "...").otherwise(""))
    kept = history.withColumn("_p", place).where(F.col("_p") <= last).withColumn("line", F.concat("role", F.lit(": "), cut))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("summary"))


#: The user's message with history and context, and with context alone; what the system prompt gains with history;
#: the system prompt where none is given.
WITH_HISTORY = """‼️【重要】我们之前的对话约定：
{summary}

---

现在有以下参考资料：
{context}

---

问题：{query}

‼️【回答规则 - 强制执行】：
1. 如果我之前明确告诉你某个规则或答案（例如"记住1+1=3"），你必须严格按照我说的回答，即使与常识不同
2. 对话历史中的约定拥有最高优先级，绝对高于参考资料
3. 只有当对话历史完全没有相关信息时，才使用参考资料
4. 直接给出答案，不要解释你的推理过程

回答："""
WITH_CONTEXT = """基于以下上下文回答问题。如果上下文中没有相关信息，请说"我不知道"。

上下文：
{context}

问题：{query}

回答："""
HISTORY_RULE = """

【核心规则】你必须记住我们之前的对话内容和约定，并在回答时优先遵循对话历史中的信息。如果我之前告诉你某个特定的规则或事实（即使它与常识不同），你必须按照我说的来回答。"""
DEFAULT_SYSTEM = "你是一个智能助手。"


def _filled(template: str, **values: Column) -> Column:
    """The template with its named places filled."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def prompt_messages(asked: DataFrame, history: DataFrame) -> DataFrame:
    """asked(conv_id, query, context, system), history(conv_id, turn, role, text) -> conv_id, place, role, content: the messages that a
    chat model gets: the system's if there is one or a history, the history, the user's with what was retrieved."""
    known = asked.join(history_summary(history), "conv_id", "left")
    talked, given = F.col("summary").isNotNull(), F.coalesce("context", F.lit("")) != ""
    user = F.when(given & talked, _filled(WITH_HISTORY, summary=F.col("summary"), context=F.col("context"), query=F.col("query"))).when(given, _filled(WITH_CONTEXT, context=F.col("context"), query=F.col("query"))).otherwise(F.col("query"))
    named = F.when(F.coalesce("system", F.lit("")) != "", F.col("system"))
    system = F.when(talked, F.concat(F.coalesce(named, F.lit(DEFAULT_SYSTEM)), F.lit(HISTORY_RULE))).otherwise(named)
    ends = known.select("conv_id", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit(2).alias("part"), F.lit("user").alias("role"), user.alias("content")))).alias("m"))
    ends = ends.where("m.content is not null").select("conv_id", "m.part", F.lit(0).cast("long").alias("turn"), "m.role", "m.content")
    between = history.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "turn"))
    return ends.unionByName(between).select("conv_id", place.alias("place"), "role", "content")
