"""Transcripts of sessions: what people wrote, which tools were called, what retrieval did. One JSON object to a line.

Two dialects are read. Lines are first tested for a piece of text that only wanted ones have, then parsed under a schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tools of the first dialect by what they do, and calls of the second.
SHELL, EDITS, READ = ["Bash"], ["Edit", "MultiEdit", "Write", "NotebookEdit"], ["Read"]
CALLS = ["custom_tool_call", "function_call", "local_shell_call"]

PART = "type string, id string, name string, text string, tool_use_id string, is_error boolean, content string, input struct<command: string, file_path: string, notebook_path: string, prepare_only: boolean>"
LINE = f"type string, isMeta boolean, isSidechain boolean, isCompactSummary boolean, message struct<content: string>, attachment struct<type: string, content: string>"


def parsed(lines: DataFrame) -> DataFrame:
    """lines (line, ..) of the first dialect with the struct ``d`` and the array of message parts ``parts``."""
    d = lines.withColumn("d", F.from_json("line", LINE))
    return d.withColumn("parts", F.from_json("d.message.content", f"array<struct<{PART}>>"))


def joined_texts(parts: Column) -> Column:
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), " ")


def user_texts(lines: DataFrame) -> DataFrame:
    """lines of a person's own words, with them as ``text``: no summaries, side chains or tools' answers."""
    d = parsed(lines.where(F.contains("line", F.lit('"user"')))).where("d.type = 'user'")
    own = ~(F.coalesce("d.isMeta", F.lit(False)) | F.coalesce("d.isSidechain", F.lit(False)) | F.coalesce("d.isCompactSummary", F.lit(False)))
    text = F.trim(F.when(F.col("d.message.content").startswith("["), F.coalesce(joined_texts(F.col("parts")), F.col("d.message.content"))).otherwise(F.col("d.message.content")))
    d = d.where(own).withColumn("text", text).drop("d", "parts")
    return d.where((F.col("text") != "") & ~F.col("text").startswith("<") & ~F.col("text").startswith("[Request interrupted"))


def tool_calls(lines: DataFrame) -> DataFrame:
    """lines with (name, kind, arg) for each tool called: shell with its command, path with the file edited, preview, or ''."""
    d = parsed(lines.where(F.contains("line", F.lit('"tool_use"'))))
    d = d.select(*lines.columns, F.explode("parts").alias("p")).where("p.type = 'tool_use'")
    name = F.coalesce("p.name", F.lit(""))
    preview = name.endswith("remember") & F.coalesce("p.input.prepare_only", F.lit(False))
    kind = F.when(preview, "preview").when(name.isin(SHELL), "shell").when(name.isin(EDITS), "path").otherwise("")
    arg = F.when(kind == "shell", F.col("p.input.command")).when(kind == "path", F.coalesce("p.input.file_path", "p.input.notebook_path"))
    return d.select(*lines.columns, name.alias("name"), kind.alias("kind"), F.coalesce(arg, F.lit("")).alias("arg"))


def hook_calls(lines: DataFrame) -> DataFrame:
    """lines with (name, input) for each tool called, the input as JSON text."""
    d = lines.where(F.contains("line", F.lit('"tool_use"'))).withColumn("_c", F.get_json_object("line", "$.message.content"))
    d = d.withColumn("_p", F.explode(F.from_json("_c", "array<struct<type: string, name: string, input: string>>"))).where("_p.type = 'tool_use'")
    return d.select(*lines.columns, F.coalesce("_p.name", F.lit("")).alias("name"), F.coalesce("_p.input", F.lit("{}")).alias("input"))


def script_calls(lines: DataFrame) -> DataFrame:
    """lines of the second dialect with (name, kind, arg): commands and patched files are taken out of the script's text."""
    d = lines.where(F.contains("line", F.lit('"payload"'))).withColumn("_p", F.from_json(F.get_json_object("line", "$.payload"), "type string, name string, input string, arguments string"))
    d = d.where(F.col("_p.type").isin(CALLS)).withColumn("_n", F.coalesce("_p.name", "_p.type")).withColumn("_raw", F.coalesce("_p.input", "_p.arguments", F.lit("")))
    plain = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\\n", "\n"), r"\\t", "\t"), r"\\(.)", "$1")
    shell = F.transform(F.regexp_extract_all("_raw", F.lit(r'cmd"?\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda c: F.struct(F.lit("shell").alias("kind"), plain(c).alias("arg")))
    files = F.transform(F.regexp_extract_all("_raw", F.lit(r"\*\*\* (?:Update|Add|Delete) File: ([^\n\\]+)"), F.lit(1)), lambda p: F.struct(F.lit("path").alias("kind"), F.trim(p).alias("arg")))
    preview = F.col("_n").endswith("remember") & F.coalesce(F.get_json_object("_raw", "$.prepare_only") == "true", F.lit(False))
    none = F.array(F.struct(F.when(preview, "preview").otherwise("").alias("kind"), F.lit("").alias("arg")))
    both = F.concat(shell, files)
    d = d.withColumn("_c", F.explode(F.when(preview | (F.size(both) == 0), none).otherwise(both)))
    return d.select(*lines.columns, F.col("_n").alias("name"), "_c.kind", "_c.arg")


def retrieval_events(lines: DataFrame, server: str = "memory", tools: list[str] = ()) -> DataFrame:
    """lines with (event, id, value): hook (what was attached), recall_call, read_call (the file), context_call (another tool
    of the server), result (the text that answers a call)."""
    wanted = F.contains("line", F.lit('"hook_additional_context"')) | F.contains("line", F.lit('"tool_use"')) | F.contains("line", F.lit('"tool_result"'))
    d = parsed(lines.where(wanted))
    content = F.coalesce(F.from_json("d.attachment.content", "array<string>"), F.array("d.attachment.content"))
    attached = d.where("d.attachment.type = 'hook_additional_context'").select(*lines.columns, F.explode(content).alias("value")).where("value is not null")
    attached = attached.select(*lines.columns, F.lit("hook").alias("event"), F.lit("").alias("id"), "value")
    p = d.select(*lines.columns, F.explode("parts").alias("p"))
    name = F.coalesce("p.name", F.lit(""))
    last = F.element_at(F.split(name, "__"), -1)
    used = F.when(name.isin(READ), "read_call").when(last == "recall", "recall_call").when(last.isin(list(tools)) | name.startswith(f"mcp__{server}__"), "context_call")
    event = F.when(F.col("p.type") == "tool_use", used).when(F.col("p.type") == "tool_result", "result")
    answer = F.when(F.col("p.content").startswith("["), F.coalesce(joined_texts(F.from_json("p.content", "array<struct<type: string, text: string>>")), F.col("p.content"))).otherwise(F.col("p.content"))
    value = F.when(event == "result", answer).when(event == "read_call", F.col("p.input.file_path")).otherwise(F.to_json("p.input"))
    p = p.withColumn("event", event).where("event is not null")
    return attached.union(p.select(*lines.columns, "event", F.coalesce("p.id", "p.tool_use_id", F.lit("")).alias("id"), F.coalesce(value, F.lit("")).alias("value")))
