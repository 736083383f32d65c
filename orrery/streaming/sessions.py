"""Sessions: batch windows, and the same as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TTL = "30 minutes"


def windows(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = TTL) -> DataFrame:
    """key, start, end, n: sessions that end after ``gap`` without an event."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_windows(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = TTL, late: str = "1 hour") -> DataFrame:
    """The same of a stream; state of a session goes once the watermark has passed its end."""
    return windows(events.withWatermark(ts, late), key, ts, gap)


def active(events: DataFrame, now, key: str = "user_id", ts: str = "ts", seconds: int = 1800) -> DataFrame:
    """Keys seen in the last ``seconds``."""
    return events.groupBy(key).agg(F.max(ts).alias("last")).where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last") <= seconds)


def exclusions(returned: DataFrame, most: int = 100) -> DataFrame:
    """session_id, ids: the newest ``most`` distinct ids returned in each session (session_id, id, ts)."""
    last = returned.groupBy("session_id", "id").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("id"))
    return last.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("session_id", "id")


def stream_exclusions(returned: DataFrame, most: int = 100, ttl_ms: int | None = 1_800_000) -> DataFrame:
    """The same as keyed state: session_id, ids (newest last); a session idle for ``ttl_ms`` (None: never) is forgotten.

    The state holds the times of its ids, as a session's rows come in several Arrow batches and in no order.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        if ttl_ms is not None and state.hasTimedOut:
            state.remove()
            return
        last = dict(zip(*state.get)) if state.exists else {}
        for b in batches:
            # micros, as state keeps no time stamps; rows without a time come first, as ORDER BY ts DESC has them last
            t = b["ts"].astype("datetime64[us]").astype("int64")
            for i, ts in zip(b["id"].tolist(), t.tolist()):
                last[i] = max(ts, last.get(i, ts))
            if len(last) > 4 * most + 1000:
                last = dict(sorted(last.items(), key=lambda x: (x[1], x[0]))[-most:])
        ids = sorted(last, key=lambda i: (last[i], i))[-most:]
        state.update((ids, [last[i] for i in ids]))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"session_id": [key[0]], "ids": [ids]})

    kind = dict(returned.dtypes)["session_id"]
    return returned.groupBy("session_id").applyInPandasWithState(step, f"session_id {kind}, ids array<bigint>", "ids array<bigint>, ts array<bigint>", "update", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def stream_history(turns: DataFrame, rounds: int = 10, ttl_ms: int | None = 1_800_000) -> DataFrame:
    """Keyed state of turns (session_id, seq, role, content): session_id, history (the newest ``rounds`` rounds as text).

    A session idle for ``ttl_ms`` (None: never) is forgotten.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        if ttl_ms is not None and state.hasTimedOut:
            state.remove()
            return
        roles, said = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        turns_ = pd.concat(list(batches)).sort_values("seq", kind="stable")  # one session's turns come in several batches
        roles += turns_["role"].tolist()
        said += turns_["content"].tolist()
        over = max(0, len(roles) - 2 * rounds)
        over += over % 2  # whole rounds go
        roles, said = roles[over:], said[over:]
        state.update((roles, said))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        text = "\n\n".join(f"{'Human' if r == 'user' else 'Assistant'}: {c}" for r, c in zip(roles, said))
        yield pd.DataFrame({"session_id": [key[0]], "history": [text]})

    kind = dict(turns.dtypes)["session_id"]
    return turns.groupBy("session_id").applyInPandasWithState(step, f"session_id {kind}, history string", "roles array<string>, said array<string>", "update", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
