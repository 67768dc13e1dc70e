"""Milestone progress of episodes on a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Before all times and steps; the time of a row that has none.
NEVER = -(1 << 62)
#: Rows that wait for the watermark are kept, and results go out, in pieces of so many.
KEPT, SENT = 1 << 13, 1 << 16
#: Groups by hash to a state, and, unless a group is an episode, episodes by hash to a value of it: 1 << EPISODE_BITS.
BUCKETS, EPISODE_BITS = 1 << 12, 6
OUTPUT = "run_id long, episode_id long, step long, stage int, fired boolean, running_return double, done boolean, late boolean, n_late long"
TAKEN = np.dtype([("run_id", "i8"), ("episode_id", "i8"), ("step", "i8"), ("at", "i8"), ("stage", "i4"), ("reward", "f8"), ("done", "?")])
GIVEN = np.dtype([("run_id", "i8"), ("episode_id", "i8"), ("step", "i8"), ("stage", "i4"), ("fired", "?"), ("running_return", "f8"), ("done", "?"), ("late", "?"), ("n_late", "i8")])


def packer(keys: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows to one a key and batch, so that a key costs a few calls and not a few a row. Like what follows, it is
    made in a function, so that it travels by value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.empty(batch.num_rows, TAKEN)
            for name in TAKEN.names:
                column = batch.column(name)
                rows[name] = column.fill_null(float("nan")) if name == "reward" else column.to_numpy(zero_copy_only=name != "done")  # ids and steps are never null
            by = [batch.column(k).to_numpy() for k in keys]
            order = np.lexsort(by)
            rows, by = rows[order], [k[order] for k in by]
            cuts = np.flatnonzero(np.any([np.diff(k, prepend=k[:1]) != 0 for k in by], axis=0))
            packed = [x.tobytes() for x in np.split(rows, cuts)] if len(rows) else []
            firsts = np.concatenate(([0], cuts)) if len(rows) else []
            yield pa.RecordBatch.from_arrays([*(pa.array(k[firsts] if len(rows) else k) for k in by), pa.array(packed, pa.binary())], [*keys, "rows"])

    return pack


def unpacker() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), GIVEN)
            for a in range(0, len(rows), SENT):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c][a : a + SENT])) for c in GIVEN.names], list(GIVEN.names))

    return unpack


def processor(ttl_ms: int, by_event_time: bool, keys: tuple[str, ...]) -> StatefulProcessor:
    """What stream_progress runs per bucket of groups. It is made in here, so that it travels by value: Spark starts a Python
    worker of its own on the driver for it, which need not find this package."""
    never, bits = NEVER, 0 if "episode_id" in keys else EPISODE_BITS
    own = tuple(dict.fromkeys((*keys, "episode_id")))
    group_type = np.dtype([*((k, "i8") for k in keys), ("mark", "i4"), ("n_late", "i8"), ("seen", "i8")])
    episode_type = np.dtype([*((k, "i8") for k in own), ("last_step", "i8"), ("total", "f8"), ("done", "?"), ("seen", "i8")])

    class Progress(StatefulProcessor):
        """State: a table of the groups' marks, late rows and last times; tables of each episode's last step, return, done
        and last time; with event time, the rows that wait for the watermark, in pieces by their first time. A table or a
        piece is one value: each call costs a round trip to the JVM, and appending to a list has the store read it."""

        def init(self, handle) -> None:
            self.handle = handle
            self.groups = handle.getValueState("groups", "rows binary")
            self.episodes = handle.getMapState("episodes", "part int", "rows binary")
            if by_event_time:
                self.waiting = handle.getMapState("waiting", "first long, serial long", "rows binary")

        def known_groups(self) -> np.ndarray:
            return np.frombuffer(self.groups.get()[0], group_type) if self.groups.exists() else np.empty(0, group_type)

        def known_episodes(self, part: int) -> np.ndarray:
            return np.frombuffer(self.episodes.getValue((part,))[0], episode_type) if self.episodes.containsKey((part,)) else np.empty(0, episode_type)

        def keep_groups(self, groups: np.ndarray) -> None:
            self.groups.update((groups.tobytes(),)) if len(groups) else self.groups.clear()

        def keep_episodes(self, part: int, episodes: np.ndarray) -> None:
            self.episodes.updateValue((part,), (episodes.tobytes(),)) if len(episodes) else self.episodes.removeKey((part,))

        def advance(self, rows: np.ndarray, now: int) -> np.ndarray:
            """Take rows, each group's in order of time, step and stage."""
            rows = rows[np.lexsort((rows["episode_id"], rows["stage"], rows["step"], rows["at"], *(rows[k] for k in keys[::-1])))]
            parts = part_of(rows["episode_id"])
            touched = np.unique(parts).tolist()
            groups, group = joined(self.known_groups(), rows, keys)
            episodes, episode = joined(np.concatenate([self.known_episodes(p) for p in touched]), rows, own)

            # By episode, and in it by time. A row's place grows with its episode and then its step.
            order = np.argsort(episode, kind="stable")
            by, r = episode[order], rows[order]
            starts = np.flatnonzero(np.diff(by, prepend=-1))
            ends = np.append(starts[1:], len(r))
            of = by[starts]
            steps, rank = np.unique(r["step"], return_inverse=True)
            place = by * len(steps) + rank
            before = np.concatenate(([-1], np.maximum.accumulate(place)[:-1]))
            _, first, which = np.unique(place, return_index=True, return_inverse=True)
            behind = (r["step"] <= episodes["last_step"][by]) | (place < before)
            late = behind[first][which]  # what comes again in a batch is as its first row
            paid = np.zeros(len(r))
            paid[first] = np.where(late[first], 0.0, r["reward"][first])
            paid[starts] += episodes["total"][of]
            total, ended = np.empty(len(r)), np.cumsum(r["done"] & ~late)
            for a, b in zip(starts.tolist(), ends.tolist()):  # one by one, as an episode's sum mustn't take in the others' roundings
                np.cumsum(paid[a:b], out=total[a:b])
            done = (ended > np.repeat(ended[starts] - (r["done"] & ~late)[starts], ends - starts)) | episodes["done"][by]
            newest = np.maximum.reduceat(np.where(late, -1, np.arange(len(r))), starts)
            highest = np.maximum.reduceat(np.where(late, never, r["step"]), starts)
            on = newest >= 0
            episodes["last_step"][of[on]] = np.maximum(episodes["last_step"][of], highest)[on]
            for name, values in (("total", total[ends - 1]), ("done", done[ends - 1]), ("seen", r["at"][newest])):
                episodes[name][of[on]] = values[on]
            held = part_of(episodes["episode_id"])
            for p in touched:
                self.keep_episodes(p, episodes[held == p])

            out = np.empty(len(rows), GIVEN)
            for name in ("run_id", "episode_id", "step", "stage"):
                out[name] = rows[name]
            for name, values in (("running_return", total), ("done", done), ("late", late)):
                out[name][order] = values
            late, starts = out["late"], np.flatnonzero(np.diff(group, prepend=-1))
            ends, of = np.append(starts[1:], len(rows)), group[starts]
            mark = groups["mark"][group].astype("i8")
            reached = np.where(late, mark, np.maximum(mark, rows["stage"]))
            low, width = reached.min(), np.ptp(reached) + 1
            marks = np.maximum.accumulate(group * width + reached - low) - group * width + low
            before = np.concatenate(([0], marks[:-1]))
            before[starts] = mark[starts]
            out["fired"] = ~late & (rows["stage"] > before)
            n_late = np.cumsum(late)
            out["n_late"] = groups["n_late"][group] + n_late - np.repeat(n_late[starts] - late[starts], ends - starts)
            groups["mark"][of], groups["n_late"][of] = marks[ends - 1], out["n_late"][ends - 1]
            groups["seen"][of] = np.maximum(groups["seen"][of], np.maximum.reduceat(np.where(late, never, rows["at"]), starts)) if by_event_time else now
            self.keep_groups(groups)
            return out

        def expire(self, before: int) -> int | None:
            """Forget what had its last rows at or before a time, the oldest last time of the rest. With event time, these
            are episodes, and groups after theirs; else groups with their episodes."""
            groups = self.known_groups()
            kept = groups[groups["seen"] > before]
            left = kept["seen"].tolist()
            if len(kept) < len(groups):
                self.keep_groups(kept)
            if by_event_time or len(kept) < len(groups):
                alive = set(zip(*(kept[k].tolist() for k in keys)))
                for (part,) in list(self.episodes.keys()):
                    episodes = self.known_episodes(part)
                    stays = episodes["seen"] > before if by_event_time else np.array([k in alive for k in zip(*(episodes[k].tolist() for k in keys))])
                    if not stays.all():
                        self.keep_episodes(part, episodes[stays])
                    left += [int(episodes["seen"][stays].min())] if by_event_time and stays.any() else []
            return min(left, default=None)

        def wake(self, times: list[int]) -> None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if times:
                self.handle.registerTimer(min(times))

        def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
            if not by_event_time:
                taken, now = np.frombuffer(b"".join(r["rows"] for r in rows), TAKEN), timerValues.getCurrentProcessingTimeInMs()
                out = self.advance(taken, now)
                self.wake([self.expire(now - ttl_ms - 1) + ttl_ms])
                for sent in pieces(out, SENT):
                    yield Row(rows=sent)
                return
            taken = []
            for batch in rows:
                taken.append(np.empty(len(batch), TAKEN))
                for name in TAKEN.names:
                    taken[-1][name] = batch[name]
            for sent in pieces(self.due(timerValues.getCurrentWatermarkInMs(), np.concatenate(taken)), SENT):
                yield pd.DataFrame({"rows": [sent]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            if by_event_time:
                for sent in pieces(self.due(timerValues.getCurrentWatermarkInMs(), np.empty(0, TAKEN)), SENT):
                    yield pd.DataFrame({"rows": [sent]})
                return
            oldest = self.expire(timerValues.getCurrentProcessingTimeInMs() - ttl_ms - 1)
            self.wake([oldest + ttl_ms] if oldest is not None else [])

        def due(self, watermark: int, rows: np.ndarray) -> np.ndarray:
            """Take the waiting rows and new ones that no earlier one can come before any more, keep the others, forget what
            is old, and set the timer."""
            kept = list(self.waiting.keys())
            ready, rest = [rows[rows["at"] <= watermark * 1000]], [rows[rows["at"] > watermark * 1000]]
            for key in [k for k in kept if k[0] <= watermark * 1000]:
                piece = np.frombuffer(self.waiting.getValue(key)[0], TAKEN)
                self.waiting.removeKey(key)
                ready.append(piece[piece["at"] <= watermark * 1000])
                rest.append(piece[piece["at"] > watermark * 1000])
            ready, rest = np.concatenate(ready), np.concatenate(rest)
            rest = rest[np.argsort(rest["at"], kind="stable")]
            serial, firsts = 1 + max((k[1] for k in kept), default=-1), [k[0] for k in kept if k[0] > watermark * 1000]
            for i, a in enumerate(range(0, len(rest), KEPT)):
                firsts.append(int(rest["at"][a]))
                self.waiting.updateValue((firsts[-1], serial + i), (rest[a : a + KEPT].tobytes(),))
            out = self.advance(ready, watermark) if len(ready) else np.empty(0, GIVEN)
            oldest = self.expire((watermark - ttl_ms) * 1000)
            times = [min(firsts) // 1000 + 1] if firsts else []
            self.wake(times + ([oldest // 1000 + ttl_ms + 1] if oldest is not None else []))
            return out

        def close(self) -> None:
            pass

    def part_of(episode_ids: np.ndarray) -> np.ndarray:
        mixed = episode_ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - bits)).astype("i8") if bits else np.zeros(len(mixed), "i8")

    def joined(known: np.ndarray, rows: np.ndarray, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """What is known, by its key columns, with what the rows add to it; for each row its place there."""
        columns = [np.concatenate((known[k], rows[k])) for k in names]
        order = np.lexsort(columns[::-1])  # stable: what is known comes before rows
        new = np.any([np.diff(c[order], prepend=c[order[:1]]) != 0 for c in columns], axis=0)
        new[0] = True
        number = np.empty(len(order), "i8")
        number[order] = np.cumsum(new) - 1
        table = np.zeros(int(new.sum()), known.dtype)
        for name in {"last_step", "seen"} & set(known.dtype.names):
            table[name] = never
        for k, c in zip(names, columns):
            table[k] = c[order[new]]
        table[number[: len(known)]] = known
        return table, number[len(known) :]

    def pieces(rows: np.ndarray, size: int) -> Iterator[bytes]:
        for a in range(0, len(rows), size):
            yield rows[a : a + size].tobytes()

    return Progress()


def stream_progress(frames: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ("run_id", "episode_id"), watermark: str | None = None, ttl_ms: int = 3_600_000, buckets: int = BUCKETS) -> DataFrame:
    """Progress rows of a stream of frames(run_id, episode_id, step, ts, kind or null, reward, done), kind being the zone
    that the frame hits, and rules a static table of (kind, stage).

    Milestones are one-shot per group of keys; ("run_id",) makes them so per run. Return and done are an episode's own in
    either case. A row at or before its episode's last step is late: it is reported as such, counted in n_late and
    changes nothing. A row without a time comes first.

    Without a watermark, rows are taken as they come, a batch's in order of time, step and stage; a group's state goes
    ttl_ms of processing time after its last rows. With one (how far behind the latest ts rows may be), a row waits until the
    watermark has passed its time, so rows of different batches are taken in order of time, and the result equals
    that of the batch operators on all rows that Spark did not drop. An episode's state goes once the watermark is ttl_ms
    past its last row, and the group's after its last episode's: what stays is bounded by what was open in that time.

    Groups that fall into one of `buckets` by hash share a state, so a batch costs a bounded number of calls to it, however
    many groups there are; a batch rewrites the states of the buckets it touches. A checkpoint's buckets must stay as many.

    Needs the RocksDB state store. With an availableNow trigger and no watermark, set
    spark.sql.streaming.noDataMicroBatches.enabled to false, or Spark goes on for the timers.
    """
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NEVER)).alias("at")
    stage, done = F.coalesce("stage", F.lit(0)).cast("int").alias("stage"), F.coalesce("done", F.lit(False)).alias("done")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")
    dim = F.broadcast(rules.select("kind", "stage"))  # a row a kind; a join by shuffle would put each kind's rows into one task
    staged = frames.join(dim, "kind", "left").select(bucket, "run_id", "episode_id", "step", "ts", at, stage, F.col("reward").cast("double").alias("reward"), done)
    if watermark is not None:
        rows = staged.withWatermark("ts", watermark).groupBy("bucket").transformWithStateInPandas(processor(ttl_ms, True, keys), "rows binary", "Update", "EventTime")
    else:
        packed = staged.drop("ts").mapInArrow(packer(("bucket",)), "bucket long, rows binary")
        rows = packed.groupBy("bucket").transformWithState(processor(ttl_ms, False, keys), "rows binary", "Update", "ProcessingTime")
    return rows.mapInArrow(unpacker(), OUTPUT)
