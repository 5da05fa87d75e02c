"""Stateful operators of streams, one small state for each key.

Each operator is a plain step: (state, row) to (state, output). fold() runs a step over a table, run() over a stream; both
take the rows of a key in the order of their time, and on a stream keys are forgotten after a time without rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[dict, dict], tuple[dict, dict | None]]


def fold(rows: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """The outputs of a step over each key's rows."""

    def each(group: pd.DataFrame) -> pd.DataFrame:
        state, out = {}, []
        for row in group.sort_values(order).to_dict("records"):
            state, got = step(state, row)
            if got is not None:
                out.append(got)
        return pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return rows.groupBy(key).applyInPandas(each, schema)


def run(rows: DataFrame, key: str, order: list[str], step: Step, schema: str, idle_ms: int = 3_600_000) -> DataFrame:
    """The outputs of a step over a stream; a key without rows for idle_ms is forgotten."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [c.split()[0] for c in schema.split(", ")]

    def each(_key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else {}
        out = []
        for row in pd.concat(list(batches)).sort_values(order).to_dict("records"):
            state, got = step(state, row)
            if got is not None:
                out.append(got)
        held.update((json.dumps(state, default=str),))
        held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(key).applyInPandasWithState(each, schema, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _seconds(ts) -> float:
    return pd.Timestamp(ts).timestamp()


def token_bucket(rate: float, burst: float) -> Step:
    """Allow a row if a token is left: tokens come back at `rate` a second, up to `burst`."""

    def step(state, row):
        now = _seconds(row["ts"])
        left = min(burst, state.get("left", burst) + max(0.0, now - state.get("at", now)) * rate)
        ok = left >= 1
        return {"left": left - 1 if ok else left, "at": max(now, state.get("at", now))}, {"id": row["id"], "allowed": ok}

    return step


def alerts(threshold: float, least: float, cooldown: float) -> Step:
    """Report a row whose share of its limit reaches a threshold, if large enough and the cooldown has passed."""

    def step(state, row):
        now, last = _seconds(row["ts"]), state.get("last")
        fire = row["value"] >= least and row["value"] / row["limit"] >= threshold and (last is None or now - last >= cooldown)
        return ({"last": now}, {"id": row["id"], "value": float(row["value"])}) if fire else (state, None)

    return step


def prefix_tracker() -> Step:
    """The frozen messages of a session: the longest prefix whose tokens fit what the cache read and wrote; 0 if nothing."""

    def step(state, row):
        cached, frozen, total = row["cache_read"] + row["cache_write"], 0, 0
        for n in row["tokens"]:
            if cached <= 0 or total + n > cached:
                break
            total, frozen = total + n, frozen + 1
        return {"frozen": frozen}, {"id": row["id"], "frozen": frozen, "before": int(state.get("frozen", 0))}

    return step


def drift(fields: list[str]) -> Step:
    """Whether the fixed part of a session's request differs from that of the one before."""

    def step(state, row):
        now = "|".join(str(row[f]) for f in fields)
        return {"was": now}, {"id": row["id"], "drifted": "was" in state and state["was"] != now}

    return step


def every(n: int) -> Step:
    """A checkpoint after each n rows of a key."""

    def step(state, row):
        count = state.get("n", 0) + 1
        return {"n": count}, {"id": row["id"], "n": count} if count % n == 0 else None

    return step


def flush(n: int) -> Step:
    """Values gathered and given out as a sum after each n rows."""

    def step(state, row):
        held = [*state.get("held", []), float(row["value"])]
        return ({"held": []}, {"id": row["id"], "total": round(sum(held), 6)}) if len(held) >= n else ({"held": held}, None)

    return step


def circuit_breaker(failures: int, wait: float) -> Step:
    """Open after so many failures in a row; after a wait, one row may try again."""

    def step(state, row):
        now, bad, opened = _seconds(row["ts"]), state.get("bad", 0), state.get("opened")
        if opened is not None and now - opened < wait:
            return state, {"id": row["id"], "state": "open"}
        bad = 0 if row["ok"] else bad + 1
        if bad >= failures or (opened is not None and not row["ok"]):
            return {"bad": bad, "opened": now}, {"id": row["id"], "state": "opened"}
        return {"bad": bad}, {"id": row["id"], "state": "closed"}

    return step


def sse_events(state: dict, chunk: bytes) -> tuple[dict, list[dict]]:
    """Complete server-sent events of a byte stream cut anywhere, also inside a character; `rest` waits for more."""
    data = bytes.fromhex(state.get("rest", "")) + chunk
    *done, rest = data.replace(b"\r\n", b"\n").split(b"\n\n")
    out = []
    for block in done:
        lines = [x.split(":", 1) for x in block.decode("utf-8", "replace").split("\n") if ":" in x and not x.startswith(":")]
        event = next((v.strip() for k, v in lines if k == "event"), "message")
        text = "\n".join(v[1:] if v.startswith(" ") else v for k, v in lines if k == "data")
        if text:
            out.append({"event": event, "data": text})
    return {"rest": rest.hex()}, out


def fold_deltas(events: list[dict]) -> dict:
    """The message and usage that a stream's deltas add up to."""
    text, usage = [], {}
    for e in events:
        if e["data"] == "[DONE]":
            break
        body = json.loads(e["data"])
        text.append(body.get("delta", {}).get("text", "") or "".join(c.get("delta", {}).get("content") or "" for c in body.get("choices", [])))
        usage |= {k: int(v) for k, v in (body.get("usage") or {}).items() if isinstance(v, int)}
    return {"text": "".join(text), "usage": usage}
