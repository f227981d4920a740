"""Libraries, members, invites and rate limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Members of a library, seconds between invites, invites an hour, and the lockout's numbers.
MOST_MEMBERS, INVITE_GAP, INVITES_PER_HOUR = 15, 30, 30
FREE_TRIES, LOCK_SECONDS, MOST_LOCK, FORGET_SECONDS = 5, 30, 900, 3600


def libraries_of(memberships: DataFrame, libraries: DataFrame) -> DataFrame:
    """Every membership with its library's name, '' where the library is gone."""
    return memberships.join(libraries, "library_id", "left").withColumn("name", F.coalesce("name", F.lit("")))


def members_of(memberships: DataFrame, accounts: DataFrame, library) -> DataFrame:
    """A library's members, the owner first, then by e-mail."""
    rows = memberships.where(F.col("library_id") == library).join(accounts, "user_id", "left")
    return rows.orderBy(F.desc("is_owner"), F.lower(F.coalesce("email", F.lit(""))), "user_id")


def capacity(memberships: DataFrame, invites: DataFrame, now: Column, most: int = MOST_MEMBERS) -> DataFrame:
    """Per library: members, open invites to join, and whether one more may be invited."""
    open_ = invites.where((F.col("status") == "pending") & (F.col("target") == "join") & (F.col("expires") > now))
    rows = memberships.select("library_id", F.lit(1).alias("m"), F.lit(0).alias("i")).unionByName(open_.select("library_id", F.lit(0).alias("m"), F.lit(1).alias("i")))
    sums = rows.groupBy("library_id").agg(F.sum("m").alias("members"), F.sum("i").alias("open_invites"))
    return sums.withColumn("may_invite", F.col("members") + F.col("open_invites") < most)


def may_accept(memberships: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    return memberships.groupBy("library_id").agg(F.count("*").alias("members")).withColumn("may_accept", F.col("members") < most)


def invite_by_token(invites: DataFrame, token_hash: str, now: Column) -> DataFrame:
    """The pending, unexpired invite of a token."""
    return invites.where((F.col("token_hash") == token_hash) & (F.col("status") == "pending") & (F.col("expires") > now))


def may_enter(requests: DataFrame, accounts: DataFrame, memberships: DataFrame) -> DataFrame:
    """requests (user_id, library_id, version) that an account, an equal token version, and a membership (or the
    user's own library) allow."""
    rows = requests.join(accounts.select("user_id", "token_version", "own_library"), "user_id").where(F.col("version") == F.col("token_version"))
    own = rows.where(F.col("library_id") == F.col("own_library"))
    joined = rows.where(~F.col("library_id").eqNullSafe(F.col("own_library"))).join(memberships.select("user_id", "library_id"), ["user_id", "library_id"], "left_semi")
    return own.select("user_id", "library_id").unionByName(joined.select("user_id", "library_id"))


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """existing, and those of wanted that it lacks; doing it twice changes nothing."""
    return existing.unionByName(wanted.dropDuplicates(keys).join(existing, keys, "left_anti"))


def allow_in_window(times, gap: int = INVITE_GAP, per_window: int = INVITES_PER_HOUR, window: int = 3600) -> list[bool]:
    """Which of some sorted times (seconds) pass: a gap since the last that passed, and so many a fixed window."""
    last, start, n, out = -(10**18), -(10**18), 0, []
    for t in times:
        ok = t - last >= gap
        if ok and t - start >= window:
            start, n = t, 0
        ok = ok and n < per_window
        if ok:
            last, n = t, n + 1
        out.append(ok)
    return out


def lockouts(times, free: int = FREE_TRIES, base: int = LOCK_SECONDS, most: int = MOST_LOCK, forget: int = FORGET_SECONDS) -> list[int]:
    """Seconds of lock after each of some sorted failures; each one over the free tries doubles it, up to a limit."""
    last, n, out = None, 0, []
    for t in times:
        n = 1 if last is None or t - last > forget else n + 1
        last = t
        out.append(min(base * 2 ** min(n - free - 1, 30), most) if n > free else 0)
    return out


def rate_limited(events: DataFrame, by: str, time_col: str, gap: int = INVITE_GAP, per_window: int = INVITES_PER_HOUR) -> DataFrame:
    """events with `allowed`, decided per key in the order of time; each decision depends on those before."""
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([time_col, *[c for c in pdf.columns if c.endswith("_id")]], ignore_index=True)
        return pdf.assign(allowed=allow_in_window(pdf[time_col].tolist(), gap, per_window))

    return events.groupBy(by).applyInPandas(run, schema)


def locked_out(failures: DataFrame, by: str, time_col: str) -> DataFrame:
    schema = T.StructType([*failures.schema.fields, T.StructField("lock_seconds", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([time_col, *[c for c in pdf.columns if c.endswith("_id")]], ignore_index=True)
        return pdf.assign(lock_seconds=lockouts(pdf[time_col].tolist()))

    return failures.groupBy(by).applyInPandas(run, schema)
