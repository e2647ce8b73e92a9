"""Trees of ``operators.trees`` over tables that one task doesn't hold; every tree is grown from all rows.

* Rows lie in blocks in a task's scratch file, beside what is known of each (node, target, fitted value), and are read block
  by block. A task thus holds a block, the sums of a level (SPREAD_CHUNK nodes at a time) and the trees, whatever the table's size.
* Boosting spreads the rows over the tasks of a barrier stage, one for each slot (MOST_TASKS at most). Each level's sums are added up over
  the tasks, all models' in one message; every task then finds the same splits.
* A forest's trees don't wait for each other, so each task has a copy of all rows (bytes) and grows its share of the trees.
* Targets are rounded to whole steps, 2^22 of them between the least and the greatest one, so that sums are exact. They don't
  depend on how rows are spread or ordered.
"""

from __future__ import annotations

import base64
import mmap
import os
import tempfile
import time
from collections.abc import Callable, Generator, Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.operators import trees
from meterlight.operators.trees import BINS, GROWN, Binned, Grower, Tree, TreeSettings
from meterlight.session import new_path, ship

BLOCK = 1 << 17
PIECE = 1 << 15  # rows whose sums and counts fit a float64's 53 bits together
STEPS = (1 << 22) - 1
ONE_ROW = 2.0**37
SPREAD_CHUNK = 1024
MOST_TASKS = 32
LEAST_ROWS = 1 << 14  # of a task
MESSAGE = 48 << 20  # bytes of all tasks' messages at once
RESIDENT = 64 << 20  # of a scratch file, beyond which its pages are given back after each block


# ---- rows of a task -------------------------------------------------------------------------


class Rows:
    """Bins (feature × row in each block), keys and targets of a task, in scratch files that vanish with it."""

    def __init__(self, batches: Iterable[pa.RecordBatch], features: int):
        self.features = features
        self.folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        self.maps: list[mmap.mmap] = []
        files = {c: self._file() for c in ("bins", "key", "y")}
        self.bounds = [0]
        for table in _blocks(batches):
            bins = np.concatenate([_bytes(c, features) for c in table["bins"].chunks])
            files["bins"].write(np.ascontiguousarray(bins.T))
            files["key"].write(np.ascontiguousarray(table["key"].to_numpy().astype(np.int64)))
            files["y"].write(np.ascontiguousarray(table["y"].to_numpy().astype(float)))
            self.bounds.append(self.bounds[-1] + len(bins))
        self.n = self.bounds[-1]
        self.bins = self._mapped(files["bins"], np.uint8, self.n * features)
        self.key = self._mapped(files["key"], np.uint64, self.n)
        self.y = self._mapped(files["y"], np.float64, self.n)

    def _file(self):
        return tempfile.TemporaryFile(dir=self.folder)

    def _mapped(self, file, kind, size: int) -> np.ndarray:
        with file:
            file.flush()
            if not size:
                return np.zeros(0, kind)
            whole = mmap.mmap(file.fileno(), 0)
        self.maps.append(whole)
        return np.frombuffer(whole, kind)

    def state(self, kind) -> np.ndarray:
        """A number for each row, zero at first."""
        file = self._file()
        file.truncate(self.n * np.dtype(kind).itemsize)
        return self._mapped(file, kind, self.n)

    def blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        for start, end in zip(self.bounds, self.bounds[1:]):
            yield slice(start, end), self.bins[start * self.features : end * self.features].reshape(self.features, -1)
            for whole in self.maps:
                if len(whole) > RESIDENT:
                    whole.madvise(mmap.MADV_DONTNEED)  # of a shared mapping: the file keeps what was written


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    some, n = [], 0
    for batch in batches:
        if batch.num_rows:
            some.append(batch)
            n += batch.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if some:
        yield pa.Table.from_batches(some)


def _bytes(column: pa.Array, features: int) -> np.ndarray:
    """Row × feature, from a column of so many bytes each."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, features)


# ---- growing --------------------------------------------------------------------------------


def add_sums(out: np.ndarray, bins: np.ndarray, columns: np.ndarray, own: np.ndarray, on: np.ndarray, target: np.ndarray):
    """Adds the targets and counts of rows ``on`` by feature, slot and bin."""
    wide = out.shape[2]
    if wide > PIECE // 4:  # many slots: their counters cost more than the rows of a piece
        first, weight = own.take(on).astype(np.intp) * BINS, target.take(on).astype(float)
        for f, c in enumerate(columns):
            at = first + bins[c].take(on)
            out[0, f] += np.bincount(at, weight, wide)
            out[1, f] += np.bincount(at, minlength=wide)
        return
    for start in range(0, len(on), PIECE):
        some = on[start : start + PIECE]
        first, weight = own.take(some).astype(np.intp) * BINS, target.take(some) + ONE_ROW
        for f, c in enumerate(columns):
            both = np.bincount(first + bins[c].take(some), weight, wide)
            count = np.floor(both / ONE_ROW)
            out[0, f] += both - count * ONE_ROW
            out[1, f] += count


class SpreadGrower(Grower):
    """A tree over a task's blocks; its sums are those of all tasks."""

    chunk = SPREAD_CHUNK
    leaves_from_parents = True

    def __init__(self, settings: TreeSettings, number: int, rows: Rows, state: dict[str, np.ndarray], low: float, step: float):
        self._start(settings, number, rows.features)
        self.rows, self.state, self.low, self.step = rows, state, low, step
        self.all_rows = settings.boosted and settings.row_share >= 1
        for s, _ in rows.blocks():
            state["node"][s] = 0
            if self.all_rows:
                continue
            times = np.bincount(trees.rows_of(rows.key[s], number, settings), minlength=s.stop - s.start)
            state["times"][s] = times
            if not settings.boosted:
                state["node"][s] = np.where(times > 0, 0, -1)

    def _sums(self, nodes: list[int]) -> np.ndarray:
        slot = np.full(len(self.nodes["left"]) + 1, -1, np.int32)  # the last one is that of rows not seen
        slot[nodes] = np.arange(len(nodes))
        out = np.zeros((2, len(self.columns), len(nodes) * BINS))
        for s, bins in self.rows.blocks():
            own = slot.take(self.state["node"][s])
            if self.all_rows:
                on = np.flatnonzero(own >= 0)
            else:
                times = self.state["times"][s]
                on = np.flatnonzero((own >= 0) & (times > 0))
                if not self.settings.boosted:
                    on = np.repeat(on, times.take(on))
            add_sums(out, bins, self.columns, own, on, self.state["target"][s])
        return out.reshape(2, len(self.columns), len(nodes), BINS).swapaxes(1, 2)

    def _real(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.low * sums[1] + self.step * sums[0], sums[1]

    def _move(self, split: dict[int, tuple]) -> None:
        feature = np.full(len(self.nodes["left"]) + 1, -1, np.intp)
        chosen = list(split)
        feature[chosen] = [self.nodes["feature"][n] for n in chosen]
        cut, left = np.array(self.nodes["cut"], np.uint8), np.array(self.nodes["left"], np.int32)
        for s, bins in self.rows.blocks():
            node = self.state["node"][s]
            column = feature.take(node)
            on = np.flatnonzero(column >= 0)
            at = node.take(on)
            value = bins.ravel().take(column.take(on) * bins.shape[1] + on)
            node[on] = left.take(at) + (value > cut.take(at))

    def values(self, tree: Tree) -> np.ndarray:
        """What ``tree``, which may have been cut back, gives for each node of the grown one."""
        stands = np.arange(len(tree.feature))
        for node, left in enumerate(self.nodes["left"]):  # children have greater numbers
            if left and tree.feature[stands[node]] < 0:
                stands[[left, left + 1]] = stands[node]
        return tree.value[stands]


Asked = tuple[str, np.ndarray]  # what to do with all tasks' numbers ("sum" or "most"), and the task's own


def _states(rows: Rows, settings: TreeSettings) -> dict[str, np.ndarray]:
    return {
        "node": rows.state(np.int32), "target": rows.state(np.uint32),
        "times": rows.state(np.uint8) if not settings.boosted or settings.row_share < 1 else None,
    }


def _scale(most: np.ndarray) -> tuple[float, float]:
    """Least target and step between two, from the greatest of (-target, target)."""
    return -most[0], (most[0] + most[1]) / STEPS or 1.0


def _range(values: Iterable[np.ndarray]) -> np.ndarray:
    most = np.full(2, -np.inf)
    for v in values:
        most = np.maximum(most, [-v.min(), v.max()])
    return most


def _grown(grower: SpreadGrower) -> Generator[Asked, np.ndarray, Tree]:
    steps, total = grower.steps(), None
    while True:
        try:
            total = yield "sum", steps.send(total)
        except StopIteration as end:
            return end.value


def _boosting(rows: Rows, own: TreeSettings, before: list[Tree], base: float, until: int) -> Generator[Asked, np.ndarray, list[Tree]]:
    """The trees of a model up to a number, and what they ask of the other tasks."""
    state, fitted, new = _states(rows, own), rows.state(np.float64), []
    for s, bins in rows.blocks():
        fitted[s] = trees.predicted(bins, base, own.rate, before)
    for number in range(len(before), until):
        low, step = _scale((yield "most", _range(rows.y[s] - fitted[s] for s, _ in rows.blocks())))
        for s, _ in rows.blocks():
            state["target"][s] = np.rint((rows.y[s] - fitted[s] - low) / step)
        grower = SpreadGrower(own, number, rows, state, low, step)
        tree = yield from _grown(grower)
        value = own.rate * grower.values(tree)
        for s, _ in rows.blocks():
            fitted[s] += value.take(state["node"][s])
        new.append(tree)
    return new


def together(jobs: dict[int, Generator], answer: Callable[[list[Asked]], list[np.ndarray]]) -> dict[int, object]:
    """Results of jobs that go on as soon as what each asked for is answered."""
    asked: dict[int, Asked] = {}
    done: dict[int, object] = {}

    def go_on(job: int, value) -> None:
        try:
            asked[job] = jobs[job].send(value)
        except StopIteration as end:
            asked.pop(job, None)
            done[job] = end.value

    for job in jobs:
        go_on(job, None)
    while asked:
        now = list(asked)
        for job, value in zip(now, answer([asked[j] for j in now])):
            go_on(job, value)
    return done


class Messages:
    """What the tasks of a barrier stage tell each other.

    Spark's own ``allGather`` takes a second, however short the message. So messages are files in the shared folder, if every
    task sees the files of all there, and go through ``allGather`` if not. A task has two files, for even and odd rounds: who
    has read all messages of a round knows that all tasks have read those of the round before.
    """

    def __init__(self, context: BarrierTaskContext, folder: str | None, tasks: int):
        self.context, self.tasks, self.folder, self.round = context, tasks, folder, 0
        self.own = str(context.taskAttemptId())  # another one when the stage runs again
        if self.folder:
            try:
                os.makedirs(self.folder, exist_ok=True)
                self._write(b"")
            except OSError:
                self.folder = None
        self.names = context.allGather(self.own)
        seen = bool(self.folder) and all(os.path.exists(self._path(n)) for n in self.names)
        if not all(text == "True" for text in context.allGather(str(seen))):
            self.folder = None

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}-{self.round % 2}"

    def _write(self, message: bytes) -> None:
        path = self._path(self.own)
        with open(f"{path}-new", "wb") as file:
            file.write(self.round.to_bytes(8, "big") + message)
        os.replace(f"{path}-new", path)

    def _read(self, name: str) -> bytes:
        head, wait = self.round.to_bytes(8, "big"), 0.0002
        while True:
            try:
                with open(self._path(name), "rb") as file:
                    if file.read(8) == head:
                        return file.read()
            except FileNotFoundError:
                pass
            time.sleep(wait)
            wait = min(2 * wait, 0.01)

    def gather(self, message: bytes) -> Iterator[bytes]:
        """All tasks' messages; all of them are to be read."""
        self.round += 1
        if self.folder:
            self._write(message)
            yield from map(self._read, self.names)
        else:
            yield from map(base64.b64decode, self.context.allGather(base64.b64encode(message).decode()))

    def merged(self, own: list[Asked]) -> list[np.ndarray]:
        return _merged(own, self.gather, self.tasks)


def _merged(own: list[Asked], gather: Callable[[bytes], Iterable[bytes]], tasks: int) -> list[np.ndarray]:
    """All tasks' numbers, added up or the greatest of each."""
    mine = np.concatenate([a.ravel() for _, a in own])
    total, most = np.zeros(len(mine)), np.full(len(mine), -np.inf)
    size = max(1, MESSAGE // (tasks * 11))  # 8 bytes are 11 characters of base 64
    for start in range(0, len(mine), size):
        end = start + size
        for message in gather(mine[start:end].tobytes()):
            part = np.frombuffer(message)
            total[start:end] += part
            np.maximum(most[start:end], part, out=most[start:end])
    out, at = [], 0
    for kind, a in own:
        out.append((total if kind == "sum" else most)[at : at + a.size].reshape(a.shape))
        at += a.size
    return out


def _batch(part: int, grown: list[Tree]) -> pa.RecordBatch:
    columns = {"part": pa.array([part], pa.int32())}
    return pa.RecordBatch.from_pydict(columns | {k: pa.array([v], pa.binary()) for k, v in trees.packed(grown).items()})


# ---- jobs -----------------------------------------------------------------------------------


def slots(spark: SparkSession) -> int:
    """Tasks that run at the same time."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def boosted(data: Binned, plans: dict[int, TreeSettings], so_far: list[list[Tree]], stage: int) -> DataFrame:
    """The next stage's trees of each model of ``plans``, all from the same rows at the same time."""
    spark = data.table.sparkSession
    ship(spark)
    tasks = min(slots(spark), MOST_TASKS, -(-data.rows // LEAST_ROWS))
    if spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        tasks = 1  # Spark has no barrier stages then
    features, base = len(data.features), data.mean
    path = urlsplit(new_path(spark, "messages"))
    folder = path.path if path.scheme in ("", "file") else None
    until = {m: min((len(so_far[m]) // stage + 1) * stage, s.trees) for m, s in plans.items()}

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(batches, features)
        jobs = {m: _boosting(rows, s, so_far[m], base, until[m]) for m, s in plans.items()}
        first, answer = True, lambda asked: [a for _, a in asked]
        if tasks > 1:
            context = BarrierTaskContext.get()
            first, answer = context.partitionId() == 0, Messages(context, folder, tasks).merged
        for m, new in together(jobs, answer).items():
            if first:
                yield _batch(m, new)

    return data.table.repartition(tasks, "key").mapInArrow(grow, GROWN, barrier=tasks > 1)


def planted(data: Binned, settings: TreeSettings) -> DataFrame:
    """A forest's trees, each by its number."""
    spark = data.table.sparkSession
    ship(spark)
    tasks = min(slots(spark), settings.trees)
    features, n = len(data.features), data.rows

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        copy = first["copy"][0].as_py()
        rows = Rows((b for some in ([first], batches) for b in some), features)
        if rows.n != n:
            raise RuntimeError(f"{rows.n} rows of {n}")
        low, step = _scale(_range(rows.y[s] for s, _ in rows.blocks()))
        state = _states(rows, settings)
        for s, _ in rows.blocks():
            state["target"][s] = np.rint((rows.y[s] - low) / step)
        for number in range(copy, settings.trees, tasks):
            tree = SpreadGrower(settings, number, rows, state, low, step).grow()
            yield _batch(number, [tree])

    copies = data.table.withColumn("copy", F.explode(F.lit(list(range(tasks)))))
    return copies.repartitionById(tasks, "copy").mapInArrow(grow, GROWN)
