"""State machines over ordered events, folded in a tree: a chunk of events is a function from states to states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query, table

#: (state, event): the state after it. Fixed values; any other pair is refused and leaves the state as it is.
SESSION = {
    ("INIT", "session_started"): "RUNNING",
    ("RUNNING", "session_paused"): "PAUSED",
    ("RUNNING", "session_completed"): "COMPLETED",
    ("RUNNING", "session_failed"): "FAILED",
    ("PAUSED", "session_resumed"): "RUNNING",
    ("PAUSED", "session_completed"): "COMPLETED",
    ("PAUSED", "session_failed"): "FAILED",
}
NODE = {
    ("PENDING", "node_started"): "RUNNING",
    ("PENDING", "node_skipped"): "SKIPPED",
    ("RUNNING", "node_finished"): "SUCCESS",
    ("RUNNING", "node_failed"): "FAILED",
    ("RUNNING", "node_skipped"): "SKIPPED",
}


def states(machine: dict[tuple[str, str], str]) -> list[str]:
    return list(dict.fromkeys([*(s for s, _ in machine), *machine.values()]))


def terminal(machine: dict[tuple[str, str], str]) -> list[str]:
    return [s for s in states(machine) if s not in {a for a, _ in machine}]


def allowed(machine: dict[tuple[str, str], str], state: str) -> list[str]:
    return [e for s, e in machine if s == state]


def fold(events: DataFrame, machine: dict[tuple[str, str], str], key: str, chunk: Column, order: list[str], event: str, start: str) -> DataFrame:
    """key, state, accepted and refused (numbers of events) after all events of each key, in order.

    Events of a key and chunk fold into a table: for every state the one after them, and how many were accepted on the
    way. A key's chunks, in order, then fold into one. So a key with very many events is no more than its chunks' tables
    in one task. chunk must grow with the order.
    """
    names = states(machine)
    moves = F.create_map(*[F.lit(x) for (s, e), new in machine.items() for x in (f"{names.index(s)}|{e}", names.index(new))])

    def step(acc: Column, x: Column) -> Column:
        new = F.element_at(moves, F.concat_ws("|", acc["s"].cast("string"), x["e"]))
        return F.struct(F.coalesce(new, acc["s"]).alias("s"), (acc["n"] + F.when(new.isNotNull(), 1).otherwise(0)).alias("n"))

    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(event).alias("e"))))
    per = events.groupBy(key, chunk.alias("_chunk")).agg(rows.alias("_rows"))
    each = F.array(*[F.aggregate("_rows", F.struct(F.lit(i).alias("s"), F.lit(0).alias("n")), step) for i in range(len(names))])
    tables = per.select(key, "_chunk", each.alias("_each"), F.size("_rows").alias("_n"))
    whole = tables.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_chunk", "_each"))).alias("_chunks"), F.sum("_n").alias("_n"))

    def join(acc: Column, c: Column) -> Column:
        after = F.get(c["_each"], acc["s"])
        return F.struct(after["s"].alias("s"), (acc["n"] + after["n"]).alias("n"))

    end = F.aggregate("_chunks", F.struct(F.lit(names.index(start)).alias("s"), F.lit(0).alias("n")), join)
    return whole.select(key, end.alias("_end"), "_n").select(key, F.get(F.array(*[F.lit(s) for s in names]), F.col("_end.s")).alias("state"), F.col("_end.n").cast("bigint").alias("accepted"), (F.col("_n") - F.col("_end.n")).alias("refused"))


#: The test log's events as a session's, and as a node's.
AS_SESSION = {"signup": "session_started", "view": "session_paused", "click": "session_resumed", "purchase": "session_completed", "error": "session_failed"}
AS_NODE = {"signup": "node_started", "view": "node_skipped", "click": "node_started", "purchase": "node_finished", "error": "node_failed"}


def _oracle(machine: dict[tuple[str, str], str], names: dict[str, str], key: str, start: str) -> str:
    moves = ", ".join(f"('{s}', '{e}', '{n}')" for (s, e), n in machine.items())
    event = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + " END"
    return f"""WITH RECURSIVE m(s, e, n) AS (VALUES {moves}), ev AS (SELECT {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i, {event} AS e FROM events),
 r AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, '{start}' AS state, CAST(0 AS BIGINT) AS ok FROM ev UNION ALL SELECT r.k, r.i + 1, coalesce(m.n, r.state), r.ok + CASE WHEN m.n IS NULL THEN 0 ELSE 1 END FROM r JOIN ev ON ev.k = r.k AND ev.i = r.i + 1 LEFT JOIN m ON m.s = r.state AND m.e = ev.e)
 SELECT k AS key, max_by(state, i) AS state, max(ok) AS accepted, max(i) - max(ok) AS refused FROM r GROUP BY k"""


def _run(spark, sf, machine, names, key: str, start: str) -> DataFrame:
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    log = table(spark, sf, "events").select(F.expr(key).alias("key"), "ts", "event_id", F.element_at(known, F.col("event_type")).alias("event"))
    return fold(log, machine, "key", F.to_date("ts"), ["ts", "event_id"], "event", start)


@query("session_machine", _oracle(SESSION, AS_SESSION, "user_id", "INIT"))
def session_machine(spark, sf):
    """Each user's events as those of a session: its last state, and how many events its table accepts."""
    return _run(spark, sf, SESSION, AS_SESSION, "user_id", "INIT")


@query("node_machine", _oracle(NODE, AS_NODE, "user_id % 3", "PENDING"))
def node_machine(spark, sf):
    """Three keys with a third of all events each, as nodes."""
    return _run(spark, sf, NODE, AS_NODE, "user_id % 3", "PENDING")
