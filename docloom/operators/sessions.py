"""Sessions and message history. All native."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def touch(events: DataFrame, user: str = "user_id", at: str = "created_at") -> DataFrame:
    """First and last time and number of messages of each user."""
    return events.groupBy(user).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.count(F.lit(1)).alias("message_count"))


def merge_sessions(sessions: DataFrame, touched: DataFrame, user: str = "user_id") -> DataFrame:
    """Known sessions move on, unknown ones begin."""
    return sessions.unionByName(touched).groupBy(user).agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("message_count").alias("message_count"))


def log_messages(messages: DataFrame, sessions: DataFrame, new: DataFrame, user: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Messages with the new ones (the same columns), and the sessions that they move on or begin."""
    return messages.unionByName(new), merge_sessions(sessions, touch(new, user), user)


def history(messages: DataFrame, limit: int = 50, user: str = "user_id", order: str = "id") -> DataFrame:
    """The last messages of every user, oldest first within the user."""
    if not 1 <= limit <= 200:
        raise ValueError("limit is 1 to 200")
    last = Window.partitionBy(user).orderBy(F.desc(order))
    return messages.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= limit).drop("rank")


def clear_history(messages: DataFrame, users: DataFrame, user: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Messages without those of the users, and how many each of them had."""
    return messages.join(users.select(user), user, "left_anti"), messages.join(users.select(user), user, "left_semi").groupBy(user).agg(F.count(F.lit(1)).alias("deleted"))


def all_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("last_seen_at"))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Each question of a user beside the answer that follows it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    nxt = conversations.withColumns({"next_role": F.lead("role").over(order), "answer": F.lead("text").over(order)})
    return nxt.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")
