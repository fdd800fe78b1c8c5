"""Conversations from message rows: each reply graph in topological order, broken ones left out."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.time import NO_END, micros
from annalist.operators.sweep import by_group, sized, stream_groups
from annalist.operators.timeshards import Cuts, find_cuts, shard_of

# What each role is called.
ROLES = {
    "system": "system developer sys instruction instructions prompt 系统 系统提示 système systeme",
    "user": "user human customer client person me asker enduser 用户 使用者 人类 客户 benutzer nutzer mensch kunde utilisateur usager humain",
    "tool": "tool function toolresult toolcall functioncall functionresult plugin observation 工具 函数 werkzeug funktion outil fonction",
    "assistant": "assistant ai bot model agent chatbot llm 助手 助理 机器人 模型 人工智能 assistent assistentin assistante modell modèle",
}
#: The order of roles at equal times.
RANK = {"system": 0, "user": 1, "tool": 2, "assistant": 3}
#: Characters that aren't seen besides blanks, separators and controls (fixed values).
UNSEEN = "͏ᅟᅠ឴឵⠀ㅤﾠ︀-️"


def role_rank(role: str | Column) -> Column:
    """0 system, 1 user, 2 tool, 3 assistant, in any spelling or synonym; null if the role can't be read."""
    plain = F.lower(F.regexp_replace(role, r"[\s\p{Z}\p{C}:：<>|\[\]()#*_.\-]+", ""))
    out = F.lit(None).cast("int")
    for name, words in ROLES.items():
        out = F.when(plain.isin(*words.split()), RANK[name]).otherwise(out)
    return out


def visible(text: str | Column) -> Column:
    """Whether the text has a character that can be seen; false for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.rlike(rf"[^\s\p{{Z}}\p{{C}}{UNSEEN}]"), F.lit(False))


def kahn(turns: list[tuple]) -> list[int]:
    """Positions of turns (order key, id, reply_to) in topological order; turns on or behind a cycle are missing.

    A turn comes after the one it replies to; of the turns that may come next the one with the least order key does. A
    reply to an unknown turn is a reply to none.
    """
    at = {t[1]: i for i, t in enumerate(turns)}
    replies: dict[int, list[int]] = {}
    ready = []
    for i, t in enumerate(turns):
        parent = at.get(t[2]) if t[2] is not None else None
        if parent is None:
            ready.append((t[0], i))
        else:
            replies.setdefault(parent, []).append(i)
    heapify(ready)
    out = []
    while ready:
        i = heappop(ready)[1]
        out.append(i)
        for j in replies.get(i, ()):
            heappush(ready, (turns[j][0], j))
    return out


_ROW = pa.schema([("session_id", pa.string()), ("shard", pa.int32()), ("local_no", pa.int64()), ("event_id", pa.string()), ("broken", pa.bool_()), ("first", pa.int32()), ("last", pa.int32())])
_DDL = "session_id string, shard int, local_no bigint, event_id string, broken boolean, first int, last int"


def _checked(key: tuple, rows: list[tuple], alone: bool) -> list[tuple]:
    """The ordered turns of a session's shard, where without any reply_to each replies to the last before its instant.

    Of a session that is one shard, there are none if it is to be dropped. rows: at, rank, id, reply_to, missing. The first row of a shard tells whether the shard is broken, and the first and
    last role of its user and assistant turns.
    """
    missing = any(r[4] for r in rows)
    turns = sorted((((r[0], -1 if r[1] is None else r[1], r[2]), r[2], r[3]) for r in rows if not r[4]), key=lambda t: t[0])
    earlier = None
    for i, t in enumerate(turns if all(t[2] is None for t in turns) else ()):
        if i and t[0][0] > turns[i - 1][0][0]:
            earlier = turns[i - 1][1]
        turns[i] = (t[0], t[1], earlier)
    order = kahn(turns)
    talk = [turns[i][0][1] for i in order if turns[i][0][1] in (1, 3)]
    broken = missing or len(order) < len(turns) or any(t[0][1] < 0 for t in turns) or any(a == b == 1 for a, b in zip(talk, talk[1:], strict=False))
    first, last = (talk[0], talk[-1]) if talk else (None, None)
    if alone and (broken or first != 1 or last != 3):
        return []
    out = [(*key, n, turns[i][1], broken, first, last) for n, i in enumerate(order, 1)]
    return out or [(*key, 0, None, broken, first, last)] if not alone else out


def conversations(turns: DataFrame, cuts: Cuts | None = None, **hot: int) -> DataFrame:
    """The ordered turns of the conversations that are whole: session_id, turn_no (from 1), event_id.

    turns: session_id, event_id (unique), at_us, rank (of the role, null if unreadable), reply_to (the event_id the turn
    replies to; where a session has none at all, each turn replies to the last one before its instant), missing (true for a row that stands for a message that should be there and isn't). Each
    session's reply graph is sorted with Kahn's algorithm, ties by at_us, then rank, then event_id. A session is dropped
    if a turn is left over (a cycle), a role unreadable, a message missing, if its user and assistant turns don't begin
    with the user's and end with the assistant's, or if a user's turn directly follows a user's.

    A session of very many turns is cut into time shards that are sorted side by side. A turn is then sorted in the shard
    of the turn it replies to if that is a later one, so the order is that of the whole graph as long as replies do not
    leave their shard; shards are joined through one summary row each. Rows with a null session, id or time are left
    out, other columns ignored, an empty table gives an empty result.
    """
    rows = turns.select("session_id", F.col("at_us").cast("bigint"), F.col("rank").cast("int"), "event_id", "reply_to", F.coalesce("missing", F.lit(False)).alias("missing"))
    rows = rows.filter("session_id IS NOT NULL AND event_id IS NOT NULL AND at_us IS NOT NULL")
    cuts = cuts or find_cuts(rows.select("session_id", "at_us"), ("session_id",), ["at_us"], **hot)
    huge = cuts.hot is not None
    rows = cuts.attach(rows).withColumn("shard", F.when(F.col("_cuts").isNull(), F.lit(None)).otherwise(shard_of(F.col("at_us")))).drop("_cuts")
    if huge:
        rows = _follow_replies(rows)
    rows = by_group(rows.select("session_id", "shard", "at_us", "rank", "event_id", "reply_to", "missing"), ["session_id", "shard"], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, group in stream_groups(batches, 2):
            out += _checked(key, [r[2:] for r in group], key[1] is None)
            if len(out) >= 20_000:
                yield from sized(out, _ROW)
                out = []
        yield from sized(out, _ROW)

    made = rows.mapInArrow(run, _DDL)
    named = F.col("local_no").alias("turn_no")
    if not huge:
        return made.select("session_id", named, "event_id")
    parts = made.filter("shard IS NOT NULL").groupBy("session_id", "shard").agg(F.max("local_no").alias("n"), F.max("broken").alias("broken"), F.max("first").alias("first"), F.max("last").alias("last"))
    w = Window.partitionBy("session_id").orderBy("shard")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("session_id")
    parts = parts.withColumn("offset", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("before", F.last("last", True).over(upto))
    bad = F.col("broken") | ((F.col("before") == 1) & (F.col("first") == 1))
    parts = parts.withColumn("bad", F.max(F.coalesce(bad, F.lit(False))).over(whole))
    parts = parts.withColumn("opens", F.min_by("first", F.when(F.col("first").isNotNull(), F.col("shard"))).over(whole)).withColumn("closes", F.max_by("last", F.when(F.col("last").isNotNull(), F.col("shard"))).over(whole))
    kept = parts.filter((~F.col("bad")) & (F.col("opens") == 1) & (F.col("closes") == 3)).select("session_id", "shard", "offset")
    cut = made.filter("shard IS NOT NULL AND event_id IS NOT NULL").join(kept, ["session_id", "shard"])
    cut = cut.select("session_id", (F.col("local_no") + F.col("offset")).alias("turn_no"), "event_id")
    return made.filter("shard IS NULL").select("session_id", named, "event_id").unionByName(cut)


def _follow_replies(rows: DataFrame) -> DataFrame:
    """Moves each turn of a huge session to the latest shard of all it replies to, directly or through others.

    By pointer jumping: in each round a turn takes over the shard of the turn it points to and then points as far as that one does, so
    rounds grow with the logarithm of the longest chain of replies. A round that moves no turn is the last, also on cycles.
    """
    from annalist.session import written

    huge = rows.filter("shard IS NOT NULL")
    known = huge.select("session_id", F.col("event_id").alias("_to")).distinct()
    points = huge.filter("reply_to IS NOT NULL").select("session_id", "event_id", F.col("reply_to").alias("_to")).join(known, ["session_id", "_to"])
    state = written(huge.select("session_id", "event_id", "shard").join(points, ["session_id", "event_id"], "left"), "replies")
    if state.filter("_to IS NOT NULL").isEmpty():
        return rows
    moved = state
    while True:
        target = moved.select("session_id", F.col("event_id").alias("_to"), F.col("shard").alias("_p"), F.col("_to").alias("_next"))
        step = moved.join(target, ["session_id", "_to"], "left").select("session_id", "event_id", F.greatest("shard", "_p").alias("shard"), F.col("_next").alias("_to"), (F.col("_p") > F.col("shard")).alias("_moved"))
        step = written(step, "replies")
        moved = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            break
    moved = moved.groupBy("session_id", "event_id").agg(F.max("shard").alias("_s"))
    return rows.join(moved, ["session_id", "event_id"], "left").withColumn("shard", F.coalesce("_s", "shard")).drop("_s").select(*rows.columns)


def pilot_turns(messages: DataFrame, events: DataFrame, expected: tuple[str, ...] = ("user.message", "agent.model.completed")) -> DataFrame:
    """The turns of chat messages whose events know the session, in the form conversations() takes.

    An event_id is one turn, at its earliest occurred_at (with the role and content of that row, ties by the least). Blank
    turns and turns without time, event or session are none; an expected event of a session that has no message row at all is a missing one.
    """
    at = F.coalesce(micros("occurred_at"), F.lit(NO_END))
    said = messages.filter(F.col("event_id").isNotNull())
    said = said.select("event_id", F.struct(at.alias("at_us"), role_rank("role").alias("rank"), visible("content").alias("seen")).alias("_m"))
    said = said.groupBy("event_id").agg(F.min("_m").alias("_m")).select("event_id", "_m.*")
    known = events.filter(F.col("session_id").isNotNull() & F.col("id").isNotNull()).groupBy(F.col("id").alias("event_id")).agg(F.min(F.struct("session_id", F.col("event_type").isin(*expected).alias("due"))).alias("_e"))
    known = known.select("event_id", "_e.session_id", F.coalesce("_e.due", F.lit(False)).alias("due"))
    both = known.join(said, "event_id", "left")
    missing = F.col("due") & F.col("at_us").isNull()
    both = both.filter(missing | F.col("seen") & (F.col("at_us") < NO_END))
    return both.select("session_id", "event_id", F.coalesce("at_us", F.lit(0)).alias("at_us"), "rank", F.lit(None).cast("string").alias("reply_to"), missing.alias("missing"))
