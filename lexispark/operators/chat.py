"""Chat history and log queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_messages(messages: DataFrame, n: int | None = 10) -> DataFrame:
    """The last n messages of every session (None: all), oldest first (``position`` from 1)."""
    if n is not None and n < 1:
        raise ValueError("n must be positive")
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = messages if n is None else messages.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


def prompt_history(messages: DataFrame, limit: int = 10, most: int = 8) -> DataFrame:
    """user and assistant messages among the last ``limit``, the last ``most`` of them: roles are filtered after the limit."""
    kept = last_messages(messages, limit).filter(F.col("role").isin("user", "assistant")).drop("position")
    return last_messages(kept, most)


def title(text: Column, most: int = 120, default: str = "New consultation") -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.coalesce(t, F.lit("")) == "", default).when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def created_title(text: Column, most: int = 120, default: str = "New consultation") -> Column:
    """The title a session begins with: cut, without an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.coalesce(t, F.lit("")) == "", default).otherwise(F.substring(t, 1, most))


def sessions(messages: DataFrame, limit: int = 50) -> DataFrame:
    """conv_id, last_turn, messages of the sessions touched last; ``limit`` is clamped to 1..200."""
    found = messages.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("messages"))
    return found.orderBy(F.desc("last_turn"), F.desc("conv_id")).limit(min(200, max(1, int(limit))))


def append(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages after an append, and those refused with the reason. Both sides (conv_id, turn, role, text); roles are
    user and assistant, texts not blank, and the session must exist."""
    known = existing.select("conv_id").distinct().withColumn("_known", F.lit(True))
    role = F.lower(F.trim("role"))
    reason = F.when(~F.coalesce(role.isin("user", "assistant"), F.lit(False)), "role").when(F.coalesce(F.trim("text"), F.lit("")) == "", "blank").when(F.col("_known").isNull(), "session")
    judged = incoming.join(known, "conv_id", "left").withColumn("reason", reason).drop("_known")
    taken = judged.filter("reason IS NULL").select("conv_id", "turn", role.alias("role"), F.trim("text").alias("text"))
    return existing.select("conv_id", "turn", "role", "text").unionByName(taken), judged.filter("reason IS NOT NULL")


def touched(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """``sessions(conv_id, updated_at)`` with the time of their newest message (``created_at``) where it is later."""
    newest = messages.groupBy("conv_id").agg(F.max("created_at").alias("_newest"))
    return sessions.join(newest, "conv_id", "left").withColumn("updated_at", F.greatest("updated_at", "_newest")).drop("_newest")


def metadata(json: Column) -> Column:
    """map<string, string> of a message's JSON metadata: bad JSON is empty, a list counts as ``citations``."""
    t = F.trim(json)
    known = F.from_json(t, "map<string,string>", {"mode": "PERMISSIVE"})
    listed = F.create_map(F.lit("citations"), t)
    valid = F.try_parse_json(t).isNotNull()
    return F.when(valid & t.startswith("["), listed).when(valid & t.startswith("{"), F.coalesce(known, F.create_map().cast("map<string,string>"))).otherwise(F.create_map().cast("map<string,string>"))
