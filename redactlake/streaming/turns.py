"""Liveness of streamed turns: a state machine over a turn's output events.

The same step runs over a stored turn and over a stream, where the state of a turn is
kept between batches and goes when the turn has ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Budgets of a turn in milliseconds and characters.
FIRST_OUTPUT, IDLE, MOST, HEADERS, TAIL = 90_000, 30_000, 210_000, 25_000, 4_000
MOST_REASONING_CHARS, MOST_REASONING_MS, LEAST_FOR_TIME = 12_000, 90_000, 1_000
OUT = "turn long, ended string, after_ms long, n long, tail string"
STATE = "n long, headers long, last long, reasoning long, since long, tail string, ended string, after long"
START = (0, 0, 0, 0, 0, "", "", 0)


def due(state: tuple, now: int) -> tuple[str, int]:
    """Why a turn has to end by `now`, and when that was; empty while it may go on."""
    n, headers, last, reasoning, since, _, _, _ = state
    if n == 0:
        if headers == 0 and now > HEADERS:
            return "unanswered", HEADERS
        return ("silent", FIRST_OUTPUT) if now > FIRST_OUTPUT else ("", 0)
    limits = [(last + IDLE, "silent"), (MOST, "ceiling")]
    if reasoning >= MOST_REASONING_CHARS:
        limits.append((last, "deliberation"))
    elif since > 0 and reasoning >= LEAST_FOR_TIME:
        limits.append((max(last, since + MOST_REASONING_MS), "deliberation"))
    at, why = min(limits, key=lambda x: (x[0], x[1]))
    return (why, at) if now > at else ("", 0)


def stepped(state: tuple, at: int, kind: str, text: str) -> tuple:
    """state after one event: headers, reasoning or output text, at `at` milliseconds of the turn."""
    n, headers, last, reasoning, since, tail, ended, after = state
    if ended:
        return state
    why, when = due(state, at)
    if why:
        return (n, headers, last, reasoning, since, tail, why, when)
    if kind == "headers":
        return (n, headers or at, last, reasoning, since, tail, ended, after)
    if kind == "reasoning":
        return (n + 1, headers, at, reasoning + len(text), since or at, tail, ended, after)
    if kind == "done":
        return (n, headers, last, reasoning, since, tail, "settled", at)
    return (n + 1, headers, at, 0, 0, (tail + text)[-TAIL:], ended, after)


def _rows(events: pd.DataFrame) -> list[tuple]:
    return sorted(zip(events["at"].tolist(), events["nth"].tolist(), events["kind"].tolist(), events["text"].fillna("").tolist(), strict=True))


def finished(turn, state: tuple) -> pd.DataFrame:
    return pd.DataFrame([(turn, state[6] or "open", state[7], state[0], state[5])], columns=["turn", "ended", "after_ms", "n", "tail"])


def turns(events: DataFrame) -> DataFrame:
    """How each stored turn (turn, nth, at, kind, text) ended; a turn without an end is taken to have stayed silent."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        state = START
        for at, _, kind, text in _rows(rows):
            state = stepped(state, int(at), kind, text)
        if not state[6]:
            why, when = due(state, 1 << 40)
            state = (*state[:6], why, when)
        return finished(key[0], state)

    return events.groupBy("turn").applyInPandas(run, OUT)


def turn_stream(events: DataFrame) -> DataFrame:
    """The same over a stream: a row for each turn once an event ends it, or once the watermark of its events' times has left it behind.

    events has a timestamp column ts besides; state is one row a turn.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else START
        if state.hasTimedOut:
            why, when = due(now, 1 << 40)
            state.remove()
            if not now[6]:
                yield finished(key[0], (*now[:6], why, when))
            return
        had = bool(now[6])
        latest = 0
        for rows in batches:
            for at, _, kind, text in _rows(rows):
                now = stepped(now, int(at), kind, text)
            latest = max(latest, int(rows["ts"].max().timestamp() * 1000))
        state.update(now)
        # state stays until the watermark has passed, so that late events find the turn ended
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + MOST)
        if now[6] and not had:
            yield finished(key[0], now)

    return events.groupBy("turn").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
