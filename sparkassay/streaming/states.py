"""Keyed states of the streaming queries, and the cuts of rows that come before them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

from ..operators.sequential import SequentialRule, stop_at

NEVER = -(1 << 63)  # stands for null in whole numbers: before all others


def _in_order(f: pd.DataFrame, keys: list[str], order: list[str]) -> pd.DataFrame:
    """The rows sorted by as many of the ``order`` columns as tell the rows of a key apart; the others would change nothing."""
    need = next((i for i in range(1, len(order)) if not f.duplicated([*keys, *order[:i]]).any()), len(order))
    return f.sort_values(order[:need], na_position="first", kind="stable")


def first_rows(keys: list[str], order: list[str], most: int):
    """The first ``most`` rows of every key in each batch of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield _in_order(f, keys, order).groupby(keys, dropna=False, sort=False).head(most)

    return run


def _top(frame: pd.DataFrame, window: int) -> pd.DataFrame:
    columns = ["iter", "seconds", "retries"]
    return frame.sort_values(columns, ascending=False, na_position="last", kind="stable").head(window)


def newest(window: int):
    """The ``window`` rows of greatest iter in each batch of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield _top(f, window)

    return run


def _names(f: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """The number of each row's key and the keys by number; null is a key."""
    group = f.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
    first = f[keys].iloc[np.unique(group, return_index=True)[1]]
    return group, [tuple(None if pd.isna(v) else v for v in row) for row in first.itertuples(index=False)]


HELD_ROWS = 100_000


class SequentialTest(StatefulProcessor):
    """Counts of trials and failures of the designs of one bucket and the rules that stopped them.

    A bucket is one call and one value, so the cost of a call, of its sort and of the way to the state is shared by its designs.
    """

    def __init__(self, keys: list[str], order: list[str], rule: SequentialRule, idle_ms: int | None):
        self.keys, self.order, self.rule, self.idle_ms = keys, order, rule, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("designs", "rows string")  # [[key, [n, k, mode, due]], ...]

    def _held(self) -> dict[tuple, list]:
        return {tuple(name): row for name, row in json.loads(self.state.get()[0])} if self.state.exists() else {}

    def _keep(self, held: dict[tuple, list]) -> None:
        self.state.update((json.dumps(list(held.items())),))

    def _first(self, frames: list[pd.DataFrame]) -> pd.DataFrame:
        f = pd.concat(frames) if len(frames) > 1 else frames[0]
        return next(first_rows(self.keys, self.order, self.rule.cap)(iter([f])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames, size, limit = [], 0, HELD_ROWS
        for f in rows:
            frames.append(f)
            size += len(f)
            if size > limit:
                frames = [self._first(frames)]
                size = len(frames[0])
                limit = max(HELD_ROWS, 2 * size)
        first = self._first(frames)
        group, names = _names(first, self.keys)
        state = self._held()
        held = [state.get(x, (0, 0, None, None)) for x in names]
        open_ = np.array([mode is None for _, _, mode, _ in held])
        at = np.argsort(group, kind="stable")  # the rows are in their order already
        at = at[open_[group[at]]]
        if not len(at):
            return
        group, unsafe = group[at], first["unsafe__"].fillna(0).to_numpy().astype(np.int64)[at]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        lengths = np.diff(np.append(starts, len(group)))
        seen, failed = (np.array([h[i] for h in held], np.int64)[group] for i in (0, 1))
        total = np.cumsum(unsafe)
        n = seen + np.arange(len(group)) - np.repeat(starts, lengths) + 1
        k = failed + total - np.repeat(total[starts] - unsafe[starts], lengths)
        counts, which = np.unique(np.column_stack([n, k]), axis=0, return_inverse=True)
        modes = [stop_at(int(x), int(y), self.rule) for x, y in counts]
        stops = np.array([m is not None for m in modes])[which.reshape(-1)]
        stop = np.minimum.reduceat(np.where(stops, np.arange(len(group)), len(group)), starts)
        last = np.minimum(stop, starts + lengths - 1)
        due = None if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        out = []
        for i in last.tolist():
            name, mode = names[group[i]], modes[which.reshape(-1)[i]]
            state[name] = [int(n[i]), int(k[i]), mode, due if mode is None else None]
            out.append((*name, int(n[i]), int(k[i]), mode))
        self._keep(state)
        if due is not None:
            self.handle.registerTimer(due)
        yield pd.DataFrame(out, columns=[*self.keys, "n", "k", "mode"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        self._keep({name: row for name, row in self._held().items() if row[3] is None or row[3] > now})
        return iter(())

    def close(self) -> None:
        pass


class Newest(StatefulProcessor):
    """The designs of the greatest iter; gives them all out after every batch."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle) -> None:
        self.held = handle.getListState("newest", "iter long, seconds double, retries double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ["iter", "seconds", "retries"]
        held = pd.DataFrame(list(self.held.get()) if self.held.exists() else [], columns=columns)
        for f in rows:
            held = _top(pd.concat([held, f[columns]]) if len(held) else f[columns], self.window)
        null = lambda x, kind: None if pd.isna(x) else kind(x)
        self.held.put([(null(i, int), null(s, float), null(r, float)) for i, s, r in held.itertuples(index=False)])
        yield held

    def close(self) -> None:
        pass


def staircase(rows: np.ndarray, target: int | None = None) -> np.ndarray:
    """The rows (t, stamp, id, ...) that are fresher than all of their target (a column) with a t up to theirs, in order of t."""
    of = np.zeros(len(rows), np.int64) if target is None else rows[:, target]
    at = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0], of))
    rows, of = rows[at], of[at]
    rank = np.zeros(len(rows), np.int64)
    rank[np.lexsort((rows[:, 2], rows[:, 1], of))] = np.arange(len(rows))  # a target's ranks are above those of the targets before
    fresh = rank > np.maximum.accumulate(np.append(-1, rank))[:-1]
    rows, of = rows[fresh], of[fresh]
    last = np.append((rows[1:, 0] != rows[:-1, 0]) | (of[1:] != of[:-1]), True) if len(rows) else np.zeros(0, bool)
    return rows[last]


def answers(steps: np.ndarray, t: np.ndarray, target: int | None = None, of: np.ndarray | None = None) -> np.ndarray:
    """(stamp, id) of the freshest step of the same target received up to each t; NEVER, NEVER without one."""
    mine = np.zeros(len(steps), np.int64) if target is None else steps[:, target]
    of = np.zeros(len(t), np.int64) if of is None else of
    asks = np.append(np.zeros(len(steps), bool), np.ones(len(t), bool))
    order = np.lexsort((asks, np.append(steps[:, 0], t), np.append(mine, of)))
    at = np.zeros(len(order), np.int64)
    at[order] = np.cumsum(~asks[order]) - 1
    at = at[len(steps) :]
    out = np.full((len(t), 2), NEVER)
    found = at >= 0
    found[found] = mine[at[found]] == of[found]
    out[found] = steps[at[found], 1:3]
    return out


STEP, OPEN = 4, 5  # whole numbers of a step (t, stamp, id, at) and of an open decision (t, id, stamp, message, at)


class MessageAges(StatefulProcessor):
    """Steps, open decisions and pending ends of the wait of the targets of one bucket, as whole numbers with that of the target.

    A bucket is one call and one value, so the cost of a call, of its sorts and of the way to the state is shared by its targets.
    """

    def __init__(self, keys: list[str], idle_ms: int | None):
        self.keys, self.idle_ms = keys, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("targets", "names string, steps binary, open binary, due binary")

    def _held(self) -> tuple[list[tuple], list[np.ndarray]]:
        names, *rows = self.state.get() if self.state.exists() else ("[]", b"", b"", b"")
        rows = [np.frombuffer(bytes(x), np.int64).reshape(-1, width + 1) for x, width in zip(rows, (STEP, OPEN, 1))]
        return [tuple(x) for x in json.loads(names)], rows

    def _keep(self, names: list[tuple], *rows: np.ndarray) -> None:
        self.state.update((json.dumps(names), *[x.astype(np.int64).tobytes() for x in rows]))

    def _out(self, names: list[tuple], rows: np.ndarray) -> pd.DataFrame:
        t, decision, stamp, message = rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]
        known = message != NEVER
        age = np.where(known & (stamp != NEVER) & (t != NEVER), t - np.where(known, stamp, 0), 0)
        out = {name: [names[i][j] for i in rows[:, -1].tolist()] for j, name in enumerate(self.keys)}
        out |= {
            "decision": _nullable(decision, decision == NEVER),
            "t": _nullable(t, t == NEVER),
            "msg_id": _nullable(message, ~known),
            "age": _nullable(age, ~known | (stamp == NEVER) | (t == NEVER)),
        }
        return pd.DataFrame(out, columns=[*self.keys, "decision", "t", "msg_id", "age"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names, (steps, waiting, due) = self._held()
        number, told, asked = {x: i for i, x in enumerate(names)}, [], []
        for f in rows:
            group, found = _names(f, self.keys)
            of = np.array([number.setdefault(x, len(number)) for x in found])[group]
            own = f["is_decision"].to_numpy(bool)
            told.append(staircase(np.column_stack([f[["t", "time_stamp", "id", "at"]].to_numpy(np.int64), of])[~own], STEP))
            asked.append(np.column_stack([f[["t", "id", "at"]].to_numpy(np.int64), of])[own])
        fresh, asked, names = np.concatenate(told), np.concatenate(asked), list(number)
        steps = staircase(np.concatenate([steps, fresh]), STEP)
        waiting = waiting.copy()
        now = answers(steps, waiting[:, 0], STEP, waiting[:, OPEN])
        better = (now != waiting[:, 2:4]).any(1)
        waiting[:, 2:4] = now
        mine = np.column_stack([asked[:, :2], answers(steps, asked[:, 0], STEP, asked[:, 3]), asked[:, 2:]])
        if self.idle_ms is not None:
            came = np.concatenate([x[:, -2:] for x in (fresh, mine)])  # (at, target)
            latest = np.full(len(names), NEVER)
            np.maximum.at(latest, came[:, 1], came[:, 0])
            touched = np.unique(came[:, 1])
            ends = np.maximum(latest[touched], timerValues.getCurrentWatermarkInMs()) + self.idle_ms
            for end in np.unique(ends).tolist():
                self.handle.registerTimer(end)
            due = np.concatenate([due, np.column_stack([ends, touched])])
        self._keep(names, steps, np.concatenate([waiting, mine]), due)
        out = np.concatenate([mine, waiting[better]])
        if len(out):
            yield self._out(names, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        names, (steps, waiting, due) = self._held()
        over = np.zeros(len(names), bool)  # the wait of a target ends with its own timer, not with another's
        over[due[due[:, 0] <= mark, 1]] = True
        if over.any():
            past = np.flatnonzero(over[steps[:, STEP]] & (steps[:, 3] <= mark))
            followed = steps[past[1:], STEP] == steps[past[:-1], STEP]
            kept = ~over[waiting[:, OPEN]] | (waiting[:, 4] > mark)
            self._keep(names, np.delete(steps, past[:-1][followed], axis=0), waiting[kept], due[due[:, 0] > mark])
        return iter(())

    def close(self) -> None:
        pass


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows in order, and the number of each row among them."""
    order = np.lexsort(keys.T[::-1])
    rows = keys[order]
    new = np.append(True, (rows[1:] != rows[:-1]).any(1))[: len(rows)]
    number = np.zeros(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    return rows[new], number


def _listed(x: np.ndarray, null: np.ndarray) -> list:
    """Plain values with None for null."""
    out = x.tolist()
    for i in np.flatnonzero(null).tolist():
        out[i] = None
    return out


CHUNK, RECORD = 4, 5  # whole numbers of a chunk (episode, chunk, closed, due) and of a record (its chunk's place, topic, t, id, bits of v)


class TraceFold(StatefulProcessor):
    """Open records of the (episode, chunk) of one bucket, which of these have ended, and when their wait ends.

    A bucket is one call and one value, so the cost of a call, of its sorts and of the way to the state is shared by its chunks.
    """

    def __init__(self, most: int, idle_ms: int | None):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("chunks", "topics string, chunks binary, records binary")

    def _held(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        topics, *rows = self.state.get() if self.state.exists() else ("[]", b"", b"")
        return json.loads(topics), *[np.frombuffer(bytes(x), np.int64).reshape(-1, width) for x, width in zip(rows, (CHUNK, RECORD))]

    def _keep(self, topics: list[str], chunks: np.ndarray, records: np.ndarray) -> None:
        self.state.update((json.dumps(topics), chunks.tobytes(), records.tobytes()))

    def _add(self, chunks: np.ndarray, records: np.ndarray, fresh: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
        """Chunks and records with the fresh rows (episode, chunk, ends, own, at, t, id, topic, bits of v)."""
        keys, of = _numbered(np.concatenate([chunks[:, :2], fresh[:, :2]]))
        old, new = of[: len(chunks)], of[len(chunks) :]
        rest = np.tile([0, NEVER], (len(keys), 1))
        rest[old] = chunks[:, 2:]
        np.maximum.at(rest[:, 0], new, fresh[:, 2])
        if self.idle_ms is not None:
            np.maximum.at(rest[:, 1], new, np.maximum(fresh[:, 4], mark) + self.idle_ms)
        own = fresh[:, 3] == 1
        here = np.column_stack([new[own], fresh[own][:, [7, 5, 6, 8]]])
        held = np.column_stack([old[records[:, 0]], records[:, 1:]])
        return np.column_stack([keys, rest]), np.concatenate([held, here])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        topics, chunks, records = self._held()
        number, fresh, size = {x: i for i, x in enumerate(topics)}, [], 0
        mark = NEVER if self.idle_ms is None else timerValues.getCurrentWatermarkInMs()

        def give(ended: bool) -> pd.DataFrame:
            nonlocal chunks, records, fresh, size
            chunks, records = self._add(chunks, records, np.concatenate(fresh), mark)
            fresh, size = [], 0
            out = np.bincount(records[:, 0], minlength=len(chunks)) > self.most
            if ended:
                out |= chunks[:, 2] == 1
            out = out[records[:, 0]]
            part, records = parts_of_chunks(list(number), chunks, records[out]), records[~out]
            return part

        for f in rows:
            code, found = pd.factorize(f["topic"].to_numpy(object))
            topic = np.array([*(number.setdefault(x, len(number)) for x in found), -1])[code]
            whole = f[["episode", "chunk", "ends", "own", "at", "t", "id"]].to_numpy(np.int64)
            fresh.append(np.column_stack([whole, topic, f["v"].to_numpy(np.float64).view(np.int64)]))
            size += len(f)
            if size > max(self.most, len(records)):
                part = give(False)
                if len(part):
                    yield part
        if fresh or (chunks[:, 2] == 1).any():
            fresh.append(np.zeros((0, 9), np.int64))
            part = give(True)
            if len(part):
                yield part
        if self.idle_ms is not None:
            for end in np.unique(chunks[:, 3]).tolist():
                self.handle.registerTimer(end)
        self._keep(list(number), chunks, records)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        topics, chunks, records = self._held()
        over = chunks[:, 3] <= mark
        if over.any():
            out = over[records[:, 0]]
            rest = records[~out]
            self._keep(topics, chunks[~over], np.column_stack([(np.cumsum(~over) - 1)[rest[:, 0]], rest[:, 1:]]))
            if out.any():
                yield parts_of_chunks(topics, chunks, records[out])

    def close(self) -> None:
        pass


def parts_of_chunks(topics: list[str], chunks: np.ndarray, records: np.ndarray) -> pd.DataFrame:
    """One row per chunk and topic of the records, in order of time and id, nulls last; null is a topic."""
    last = lambda x: np.where(x == NEVER, np.iinfo(np.int64).max, x)
    rows = records[np.lexsort((last(records[:, 3]), last(records[:, 2]), records[:, 1], records[:, 0]))]
    start = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))[: len(rows)])
    cut = list(zip(start.tolist(), [*start[1:].tolist(), len(rows)]))
    at, vals = chunks[rows[start, 0]], np.ascontiguousarray(rows[:, 4]).view(np.float64)
    columns = {c: _nullable(at[:, i], at[:, i] == NEVER) for i, c in enumerate(("episode", "chunk"))}
    columns["topic"] = [topics[i] if i >= 0 else None for i in rows[start, 1].tolist()]
    for c, x, null in (("times", rows[:, 2], rows[:, 2] == NEVER), ("ids", rows[:, 3], rows[:, 3] == NEVER), ("vals", vals, np.isnan(vals))):
        values = _listed(x, null)
        columns[c] = [values[a:b] for a, b in cut]
    return pd.DataFrame(columns | {"complete": at[:, 2] == 1})


def topic_parts(key: tuple, held: list[list], complete: bool) -> pd.DataFrame:
    """The parts of one chunk, whose records come as lists (topics, times, ids, values)."""
    code, topics = pd.factorize(np.array(held[0], object))
    t, i = (np.array([NEVER if x is None else x for x in values], np.int64) for values in held[1:3])
    records = np.column_stack([np.zeros(len(code), np.int64), code, t, i, np.array(held[3], np.float64).view(np.int64)])
    return parts_of_chunks(list(topics), np.array([[*key, int(complete), NEVER]]), records)


def _nullable(x: np.ndarray, null: np.ndarray):
    return pd.arrays.IntegerArray(np.where(null, 0, x).astype(np.int64), null.copy())
