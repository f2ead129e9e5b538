"""Signals of actions in notes and in use, and rules that come of them."""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from memolake.functions import text as T
from memolake.tables import little, staged

MOST_WORDS, LEAST_USES, WIDE_RATE, PER_SIGNAL = 3, 3, 5.0, 5
#: So many rules or signals are broadcast; more are joined by a shuffle.
FEW = 100_000

# What ends a command, what a command's words are made of, how a heredoc begins, what code in a note is.
ENDS = re.compile(r"\n|;|&&|\|\||\||\$\(|`|\bthen\b|\bdo\b|\belse\b")
PIECES = re.compile(r"[A-Za-z0-9_.\-/]+")
HEREDOC = re.compile(r"<<-?\s*['\"]?([A-Za-z_][A-Za-z0-9_]*)['\"]?")
ASSIGNS = re.compile(r"(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s*)+")
CODE = r"(?s)`([^`\n]{2,80})`|```[a-z]*\n(.*?)```"


def without_heredocs(command: str) -> str:
    kept, tag = [], None
    for line in command.split("\n"):
        if tag is not None:
            tag = None if line.strip() == tag else tag
            continue
        begins = HEREDOC.search(line)
        tag = begins and begins[1]
        kept.append(line[: begins.start()] if begins else line)
    return "\n".join(kept)


def signals_of(command: str) -> list[str]:
    """The first one, two and three words of each command, in 2 to 60 characters; a program without its folder."""
    found = set()
    for part in ENDS.split(without_heredocs(command)):
        words = PIECES.findall(ASSIGNS.sub("", part.strip(), count=1) if ASSIGNS.match(part.strip()) else part)
        if words:
            words[0] = posixpath.basename(words[0])
            found |= {" ".join(words[:n]) for n in range(1, min(MOST_WORDS, len(words)) + 1)}
    return sorted(s for s in found if 2 <= len(s) <= 60)


@F.pandas_udf(ArrayType(StringType()))
def command_signals(commands: pd.Series) -> pd.Series:
    """Signals of shell commands, without heredocs' bodies and leading assignments."""
    return commands.fillna("").map(signals_of)


def note_signals(notes: DataFrame, home: list[str] = ()) -> DataFrame:
    """(signal, note, tf) of notes (name, raw): usable signals of the code in them, and how often each stands in the note."""
    rx = F.lit(CODE)
    pieces = F.filter(F.transform(F.concat(F.regexp_extract_all("raw", rx, F.lit(1)), F.regexp_extract_all("raw", rx, F.lit(2))), lambda c: F.trim(c)), lambda c: F.length(c).between(1, 400))
    code = notes.select("name", "raw", F.explode(pieces).alias("code"))
    of_commands = code.select("name", "raw", F.explode(command_signals("code")).alias("signal"))
    words = F.filter(F.regexp_extract_all("code", F.lit(r"[A-Za-z0-9_.\-/]{2,60}"), F.lit(0)), lambda w: w != "")
    of_paths = code.select("name", "raw", F.explode(words).alias("word")).select("name", "raw", F.explode(T.path_signals(F.col("word"))).alias("signal"))
    d = of_commands.union(of_paths).where(T.usable_signal(F.col("signal"), list(home))).distinct()
    times = (F.length("raw") - F.length(F.replace("raw", F.col("signal"), F.lit("")))) / F.length("signal")
    return d.select("signal", F.col("name").alias("note"), times.cast("long").alias("tf"))


def signal_uses(calls: DataFrame) -> DataFrame:
    """(signal, uses, shell, path) of calls (kind, arg): in how many a signal stands, by where."""
    shell = calls.where("kind = 'shell'").select(F.explode(command_signals("arg")).alias("signal"), F.lit(1).alias("shell"), F.lit(0).alias("path"))
    path = calls.where("kind = 'path'").select(F.explode(T.path_signals(F.col("arg"))).alias("signal"), F.lit(0), F.lit(1))
    return shell.union(path).groupBy("signal").agg(F.count(F.lit(1)).alias("uses"), F.sum("shell").alias("shell"), F.sum("path").alias("path"))


def standing_in(texts: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """texts with each ``phrase`` that stands in them. They meet by the phrase's first two or three characters."""
    from memolake.operators.lexical import cuts

    p = phrases.select("phrase").distinct().where(F.length("phrase") >= 2).withColumn("cut", F.substring("phrase", 1, 3))
    keyed = texts.withColumn("_key", F.xxhash64(text))
    met = keyed.select("_key", F.explode(cuts(F.col(text))).alias("cut")).join(little(p, FEW), "cut").select("_key", "phrase").distinct()
    return keyed.join(met, "_key").where(F.contains(F.col(text), F.col("phrase"))).drop("_key")


def candidates(noted: DataFrame, uses: DataFrame, known: DataFrame, calls: int, least: int = LEAST_USES) -> DataFrame:
    """(signal, uses, notes, tf, rate, known, covered, broader, place): signals of notes that are used, with the notes that have
    them most. known: phrases of rules. Wide ones come last, then those that stand in a known phrase; the most used first."""
    used = noted.join(uses.where(F.col("uses") >= least), "signal")
    place = F.row_number().over(Window.partitionBy("signal").orderBy(F.desc("tf"), "note"))
    picked = used.withColumn("_r", place).where(F.col("_r") <= PER_SIGNAL).groupBy("signal").agg(F.first("uses").alias("uses"), F.transform(F.array_sort(F.collect_list(F.struct("_r", "note"))), lambda x: x["note"]).alias("notes"), F.max("tf").alias("tf"))
    own = picked.select("signal")
    covered = standing_in(own, "signal", known).select("signal").distinct().withColumn("covered", F.lit(True))
    broader = standing_in(known.select(F.col("phrase").alias("of")).distinct(), "of", own.select(F.col("signal").alias("phrase"))).where("of <> phrase").select(F.col("phrase").alias("signal")).distinct().withColumn("broader", F.lit(True))
    same = known.select(F.col("phrase").alias("signal")).distinct().withColumn("known", F.lit(True))
    d = picked.join(covered, "signal", "left").join(broader, "signal", "left").join(same, "signal", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return d.select("signal", "uses", "notes", "tf", (F.lit(100.0) * F.col("uses") / max(calls, 1)).alias("rate"), no("known"), no("covered"), no("broader"))


def proposals(found: DataFrame, judged: DataFrame, least: float = 7.0) -> DataFrame:
    """(signal, uses, rate, top, notes, broader): candidates of which a judged note (signal, note, score) reaches the least,
    without those that a shorter proposal, not itself wide, stands in, unless they are wide."""
    kept = found.select("signal", "uses", "rate", "broader", F.explode("notes").alias("note")).join(judged.where(F.col("score") >= least), ["signal", "note"])
    p = kept.groupBy("signal", "uses", "rate", "broader").agg(F.max("score").alias("top"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "note"))), lambda x: x["note"]).alias("notes"))
    narrow = p.where(F.col("rate") < WIDE_RATE)
    eaten = standing_in(narrow.select("signal"), "signal", narrow.select(F.col("signal").alias("phrase"))).where("signal <> phrase").select("signal").distinct()
    return p.join(eaten, "signal", "left_anti")


def fired(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """(session, call, rule): calls (session, call, tool, input) that a rule (rule, tool, phrase) fires at: the tool is its own,
    and a phrase stands in the input."""
    met = standing_in(calls, "input", rules.select("phrase"))
    r = rules.select(F.col("rule"), F.col("tool").alias("_tool"), F.col("phrase").alias("_phrase"))
    return met.join(little(r, FEW), (F.col("tool") == F.col("_tool")) & (F.col("phrase") == F.col("_phrase"))).select("session", "call", "rule").distinct()


def fire_rates(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, fires, calls, rate): in how many calls of its tools a rule fires, in per cent."""
    of_tool = calls.groupBy("tool").agg(F.count(F.lit(1)).alias("n"))
    all_of = rules.select("rule", "tool").distinct().join(of_tool, "tool").groupBy("rule").agg(F.sum("n").alias("calls"))
    fires = fired(calls, rules).groupBy("rule").agg(F.count(F.lit(1)).alias("fires"))
    d = all_of.join(fires, "rule", "left").select("rule", F.coalesce("fires", F.lit(0)).alias("fires"), "calls")
    return d.withColumn("rate", F.col("fires") * 100.0 / F.greatest("calls", F.lit(1)))


def active_rules(calls: DataFrame, rules: DataFrame, least: int = 20) -> DataFrame:
    """One row (sessions, median, p90): distinct rules that fire in a session of so many calls or more; of n in order, those at
    n / 2 and at 0.9 n, from 0."""
    long = calls.groupBy("session").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("session")
    live = fired(calls, rules).groupBy("session").agg(F.countDistinct("rule").alias("live"))
    counts = long.join(live, "session", "left").groupBy(F.coalesce("live", F.lit(0)).alias("live")).agg(F.count(F.lit(1)).alias("sessions"))
    upto = F.sum("sessions").over(Window.orderBy("live"))  # one row for each number of rules
    total = F.sum("sessions").over(Window.partitionBy(F.lit(0)))
    d = counts.withColumn("upto", upto).withColumn("total", total)
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("total") * q), F.col("live")))
    return d.agg(F.coalesce(F.max("total"), F.lit(0)).alias("sessions"), F.coalesce(at(0.5), F.lit(0)).alias("median"), F.coalesce(at(0.9), F.lit(0)).alias("p90"))


def matched_rules(calls: DataFrame, rules: DataFrame) -> DataFrame:
    return fired(calls, rules).groupBy("session", "call").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def cold_rules(rules: DataFrame, uses: DataFrame) -> DataFrame:
    """(rule, cold, all_cold): phrases of rules that no used signal is or holds."""
    warm = standing_in(uses.select("signal"), "signal", rules.select("phrase")).select("phrase").distinct()
    short = rules.where(F.length("phrase") < 2).select("phrase").join(uses.select(F.col("signal").alias("phrase")), "phrase", "left_semi")
    d = rules.select("rule", "phrase").distinct().join(warm.union(short).distinct().withColumn("warm", F.lit(True)), "phrase", "left")
    out = d.groupBy("rule").agg(F.array_sort(F.collect_list(F.when(F.col("warm").isNull(), F.col("phrase")))).alias("cold"), F.count(F.lit(1)).alias("n"))
    return out.where(F.size("cold") > 0).select("rule", "cold", (F.size("cold") == F.col("n")).alias("all_cold"))


def path_key(signal: Column) -> Column:
    """What two spellings of a path have in common: its parts in lower case, without a slash at the end."""
    return F.lower(F.regexp_replace(signal, "/+$", ""))


def approved(found: DataFrame, rates: DataFrame, dismissed: DataFrame, rules: DataFrame, least_score: float = 10.0, least_uses: int = 50, most: int = 5) -> DataFrame:
    """(signal, place): proposals that become rules without a person: sure, often used, not dismissed, caught by no rule (rule,
    phrase, note), rare (the worse of both rates), holding no known phrase, and with a note that no rule has. They are taken
    one by one in order, each after what those before it brought."""
    new = found.where((F.col("top") >= least_score) & (F.col("uses") >= least_uses) & ~F.col("broader"))
    new = new.join(dismissed.select("signal"), "signal", "left_anti").join(rates.select(F.col("rule").alias("signal"), F.col("rate").alias("real")), "signal", "left")
    new = new.where(F.greatest(F.coalesce("real", F.lit(0.0)), "rate") < WIDE_RATE)
    caught = standing_in(new.select("signal"), "signal", rules.select("phrase")).select("signal").distinct()
    new = new.join(caught, "signal", "left_anti")
    keys = rules.where(F.contains("phrase", F.lit("/"))).select(path_key(F.col("phrase")).alias("key")).distinct()
    new = new.withColumn("key", path_key(F.col("signal"))).join(keys, "key", "left_anti")
    fresh = new.select("signal", F.explode("notes").alias("note")).join(rules.select("note").distinct(), "note", "left_anti").groupBy("signal").agg(F.collect_set("note").alias("fresh"))
    new = staged(new.join(fresh, "signal").select("signal", "key", "top", "uses", "notes", "fresh"), "approvable")
    taken = []
    for _ in range(most):
        one = new.orderBy(F.desc("top"), F.desc("uses"), "signal").limit(1).collect()  # one row
        if not one:
            break
        taken.append((one[0]["signal"], len(taken) + 1))
        news = F.size(F.array_except("fresh", F.array(*map(F.lit, one[0]["notes"])))) > 0
        new = new.where(~F.contains("signal", F.lit(one[0]["signal"])) & news & ~(F.contains("signal", F.lit("/")) & (F.col("key") == one[0]["key"])))
    return new.sparkSession.createDataFrame(taken, "signal string, place int")
