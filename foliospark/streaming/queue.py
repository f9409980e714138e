"""A leased job queue as keyed state: claims, heartbeats, fencing, retries, replays.

The rules are one pure state machine; :func:`decide_batch` runs it over a table of
events, :func:`decide_stream` over a stream, with equal decisions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds of a lease; of the pause per failure; failures that end a job; seconds a worker counts as alive; seconds a request waits.
LEASE, PAUSE, FAILURES, ALIVE, WAIT = 300, 30, 3, 60, 30

EVENT = "recipe string, at bigint, seq bigint, kind string, job string, attempt string, body string, document boolean, capacity int"
DECISION = "recipe string, at bigint, seq bigint, kind string, job string, outcome string, attempt string"


def fresh() -> dict[str, Any]:
    """The state of a recipe nobody has used."""
    return {"jobs": {}, "seen": None}


def step(state: dict[str, Any], event: dict[str, Any]) -> list[tuple[str | None, str, str | None]]:
    """(job, outcome, attempt) of one event; changes the state.

    submit: queued, or what stands already (cached, waiting), or unavailable without a live worker.
    claim: claimed jobs, the earliest deadline first, up to the capacity, or empty.
    heartbeat, fail, complete: only under the job's own, unexpired attempt; a repeated
    completion is replayed if it is the same, else a conflict.
    """
    now, jobs, name = event["at"], state["jobs"], event.get("job")
    kind = event["kind"]
    job = jobs.get(name)
    # What nobody waits for any more, done or not, is forgotten, so the state holds open requests and kept documents only.
    if kind == "claim":
        for key in [k for k, j in jobs.items() if not j["document"] and j["deadline"] <= now]:
            del jobs[key]
    elif job and not job["document"] and job["deadline"] <= now:
        del jobs[name]
        job = None
    if kind == "submit":
        if job and job["complete"] and (job["document"] or job["deadline"] > now):
            return [(name, "cached", None)]
        if job and not job["error"]:
            return [(name, "waiting", None)]
        document = bool(event.get("document"))
        if not document and (state["seen"] is None or now - state["seen"] >= ALIVE):
            return [(name, "unavailable", None)]
        jobs[name] = {"document": document, "deadline": 2**62 if document else now + WAIT, "attempt": None, "expires": 0, "failures": 0, "error": None, "complete": False, "body": None}
        return [(name, "queued", None)]
    if kind == "claim":
        state["seen"] = now
        out = []
        for key in sorted(jobs, key=lambda k: (jobs[k]["deadline"], k)):
            j = jobs[key]
            if len(out) >= (event.get("capacity") or 0):
                break
            if j["complete"] or j["error"] or j["expires"] > now or (not j["document"] and j["deadline"] <= now):
                continue
            # The attempt is made of the event, so a replayed stream gives the same one.
            j["attempt"], j["expires"] = f"{event['seq']}-{key}", now + LEASE
            out.append((key, "claimed", j["attempt"]))
        return out or [(None, "empty", None)]
    if job is None:
        return [(name, "unknown", None)]
    if job["attempt"] != event.get("attempt"):
        return [(name, "superseded", None)]
    if kind == "complete" and job["complete"]:
        return [(name, "replayed" if job["body"] == event.get("body") else "conflict", None)]
    if job["expires"] <= now or job["complete"]:
        return [(name, "expired", None)]
    if kind == "heartbeat":
        state["seen"] = now
        job["expires"] = now + LEASE
        return [(name, "extended", job["attempt"])]
    if kind == "fail":
        job["failures"] += 1
        job["attempt"], job["expires"] = None, now + PAUSE * job["failures"]
        if job["failures"] >= FAILURES:
            job["error"] = event.get("body") or "failed"
            return [(name, "failed", None)]
        return [(name, "retry", None)]
    if kind == "complete":
        job["complete"], job["body"] = True, event.get("body")
        return [(name, "completed", job["attempt"])]
    return [(name, "ignored", None)]


def _run(state: dict[str, Any], rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for event in rows.sort_values(["at", "seq"]).to_dict("records"):
        event = {k: None if not isinstance(v, (list, dict)) and pd.isna(v) else v for k, v in event.items()}
        for job, outcome, attempt in step(state, event):
            out.append((event["recipe"], event["at"], event["seq"], event["kind"], job, outcome, attempt))
    return pd.DataFrame(out, columns=[c.split()[0] for c in DECISION.split(", ")])


def decide_batch(events: DataFrame) -> DataFrame:
    """Decisions over a finished table of events (:data:`EVENT`), in (at, seq) order per recipe."""
    return events.groupBy("recipe").applyInPandas(lambda rows: _run(fresh(), rows), DECISION)


def decide_stream(events: DataFrame) -> DataFrame:
    """The same over a stream; state is one JSON text per recipe and outlives a restart by the checkpoint."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else fresh()
        rows = pd.concat(list(batches))
        out = _run(held, rows)
        state.update((json.dumps(held),))
        yield out

    return events.groupBy("recipe").applyInPandasWithState(run, DECISION, "state string", "append", GroupStateTimeout.NoTimeout)


def reconcile(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(job, status): jobs (job, fingerprint, status, expires) against what is wanted (job, fingerprint) at time ``now``.

    Gone definitions are removed, changed fingerprints and expired runs queued again, new ones queued.
    """
    a = jobs.select("job", F.col("fingerprint").alias("_f"), F.col("status").alias("_s"), F.col("expired").alias("_x"))
    b = wanted.select(F.col("job").alias("_j"), F.col("fingerprint").alias("_w"))
    status = F.when(F.col("_j").isNull(), "removed").when(F.col("job").isNull() | (F.col("_f") != F.col("_w")), "queued").when((F.col("_s") == "running") & F.col("_x"), "queued").otherwise(F.col("_s"))
    return a.join(b, F.col("job") == F.col("_j"), "full_outer").select(F.coalesce("job", "_j").alias("job"), status.alias("status"))
