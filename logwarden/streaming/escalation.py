"""Address rules as a stateful stream: rules escalate as events arrive, late rows leave on their own.

State per source address: counts, first places, ports seen and the newest minute. Events are combined by (address, minute,
port) inside each task before they are shuffled, so an address with a third of all rows sends few of them. Event-time timers
on the arrival time free the state of addresses that fell silent.

Late is a matter of the address: a row is late when its minute is more than ``allowed_minutes`` before the newest minute that
an earlier batch held for it. Late rows never change counts; they leave as rows of part ``late``, one for each minute and port.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from logwarden.functions.text import is_alert
from logwarden.operators.detect import _acts, detections, is_failed_login

COUNTS = ("n_events", "n_failed", "n_success", "n_priv", "n_dns", "n_outbound", "n_alerts")
FIRSTS = ("first_seq", "first_alert_seq")
_PARTIAL = "source_ip string, minute bigint, port int, " + ", ".join(f"{c} bigint" for c in COUNTS + FIRSTS)
_STATE = ", ".join(f"{c} bigint" for c in COUNTS + FIRSTS) + ", newest bigint, ports binary"
_OUTPUT = "part string, source_ip string, minute bigint, port int, n_ports bigint, " + ", ".join(f"{c} bigint" for c in COUNTS + FIRSTS)
RUNNING, LATE, CLOSED = "running", "late", "closed"


def combined(events: DataFrame) -> DataFrame:
    """Events with a time and an address, combined inside each Arrow batch of a task: no shuffle."""
    alert = is_alert(F.col("status"))
    one = lambda condition: F.coalesce(condition, F.lit(False)).cast("bigint")
    rows = events.where(F.col("ts").isNotNull() & (F.length("source_ip") > 0)).select(
        "source_ip", F.floor(F.unix_seconds("ts") / 60).cast("bigint").alias("minute"), F.col("port").cast("int").alias("port"),
        F.lit(1).cast("bigint").alias("n_events"), one(is_failed_login()).alias("n_failed"), one(_acts("successful_login")).alias("n_success"),
        one(_acts("priv_escalation")).alias("n_priv"), one(_acts("dns_query")).alias("n_dns"), one(_acts("outbound_conn", "exfiltration")).alias("n_outbound"),
        one(alert).alias("n_alerts"), F.col("ingest_seq").alias("first_seq"), F.when(alert, F.col("ingest_seq")).alias("first_alert_seq"))
    keys = ["source_ip", "minute", "port"]

    def combine(batches):
        for batch in batches:
            made = pa.Table.from_batches([batch]).group_by(keys).aggregate([(c, "sum") for c in COUNTS] + [(c, "min") for c in FIRSTS])
            made = made.select(keys + [f"{c}_sum" for c in COUNTS] + [f"{c}_min" for c in FIRSTS]).rename_columns(keys + [*COUNTS, *FIRSTS])
            yield from made.to_batches()

    return rows.mapInArrow(combine, _PARTIAL)


def _least(a: int | None, b) -> int | None:
    return a if pd.isna(b) else int(b) if a is None else min(a, int(b))


def _state_row(part: str, key, held) -> pd.DataFrame:
    values = dict(zip([*COUNTS, *FIRSTS], held))
    return _typed(pd.DataFrame([{"part": part, "source_ip": key[0], "minute": held[-2], "port": None, "n_ports": len(held[-1]) // 2, **values}]))


def _advance(allowed: int, idle_ms: int):
    """The state function: ports are packed two bytes each, so a state has at most 128 KB."""
    def step(key, rows, state):
        if state.hasTimedOut:
            yield _state_row(CLOSED, key, state.get)
            state.remove()
            return
        held = list(state.get) if state.exists else [0] * len(COUNTS) + [None, None, None, b""]
        before, seen = held[-2], np.frombuffer(bytes(held[-1]), dtype=np.uint16)
        changed, arrived = False, 0
        for pdf in rows:
            arrived = max(arrived, int(pdf["arrived_ms"].max()))
            late = pdf["minute"] < before - allowed if before is not None else pd.Series(False, index=pdf.index)
            if late.any():
                yield _typed(pdf.loc[late].assign(part=LATE, n_ports=0))
            kept = pdf[~late]
            if not len(kept):
                continue
            changed = True
            for i, c in enumerate(COUNTS):
                held[i] += int(kept[c].sum())
            for i, c in enumerate(FIRSTS, len(COUNTS)):
                held[i] = _least(held[i], kept[c].min())
            seen = np.union1d(seen, kept["port"].dropna().to_numpy().astype(np.uint16))
            held[-2] = int(max(kept["minute"].max(), held[-2] if held[-2] is not None else kept["minute"].max()))
        if changed:
            held[-1] = seen.tobytes()
            state.update(tuple(held))
            yield _state_row(RUNNING, key, held)
        state.setTimeoutTimestamp(arrived + idle_ms)

    return step


def _typed(pdf: pd.DataFrame) -> pd.DataFrame:
    whole = {c: "Int64" for c in ["minute", "n_ports", *COUNTS, *FIRSTS]} | {"port": "Int32"}
    return pdf[["part", "source_ip", "minute", "port", "n_ports", *COUNTS, *FIRSTS]].astype(whole)


def address_states(events: DataFrame, allowed_minutes: int = 10, idle: str = "30 days") -> DataFrame:
    """Per batch: the running counts of each address that changed, its late rows, and addresses closed after ``idle`` of arrivals.

    Update mode. Rows without a time do not take part (``streams.timed`` splits them off).
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    arriving = combined(events).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds").withColumn("arrived_ms", F.unix_millis("arrived"))
    return arriving.groupBy("source_ip").applyInPandasWithState(
        _advance(allowed_minutes, idle_ms), _OUTPUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def running(landed: DataFrame) -> DataFrame:
    """Newest counts of each address, in the columns that the batch rules read."""
    values = [*COUNTS, "n_ports", *FIRSTS]
    newest = landed.where(F.col("part") == RUNNING).groupBy("source_ip").agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return newest.select("source_ip", "v.*")


def late(landed: DataFrame) -> DataFrame:
    """Late rows, by address, minute and port."""
    return landed.where(F.col("part") == LATE).drop("part", "n_ports")


def escalations(landed: DataFrame) -> DataFrame:
    """One row each time that a rule of an address fires first, changes its kind or grows in risk, with the batch that did it."""
    spark = landed.sparkSession
    none = spark.createDataFrame([], "endpoint string, n_events bigint, n_confirmed bigint, first_seq bigint")
    at = F.struct("source_ip", "batch_id")
    rows = landed.where(F.col("part") == RUNNING).select(F.to_json(at).alias("source_ip"), *COUNTS, "n_ports", *FIRSTS)
    found = detections(rows, none).withColumn("at", F.from_json("key", "source_ip string, batch_id bigint"))
    # the credential rule may change kind; other rules keep theirs
    by = found.select(F.col("at.source_ip").alias("source_ip"), F.col("at.batch_id").alias("batch_id"), "rule_order", "kind", "title", "risk")
    first = by.groupBy("source_ip", "rule_order", "kind", "title", "risk").agg(F.min("batch_id").alias("batch_id"))
    return first.select("batch_id", "source_ip", "rule_order", "kind", "title", "risk")
