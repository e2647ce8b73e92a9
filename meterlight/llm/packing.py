"""Best-fit packing of tokenised documents into sequences, planned on the counts of lengths.

Documents become pieces of at most ``capacity`` tokens. How many pieces have each length is
all that planning needs: at most ``capacity`` numbers, whatever the number of documents.

1. Linear grouping: large pieces are sorted by length and dealt into ``groups`` groups of equal
   cardinality; each length is rounded up to its group's longest. From which length on a piece
   is large is tried at some shares of the capacity.
2. Configurations: the linear programme over fillings of a sequence by rounded sizes is solved
   by column generation; its whole part is taken, the rest is packed best-fit.
3. Substitution: actual pieces, longest first, take the places of their group.
4. Best fit: the small pieces, longest first, go to the fullest sequence that holds them.

The plan names, for each length, runs of places; the executors number the pieces of each length
(by bucket, so that no length is numbered in one task) and look their places up.

Null and empty texts have one piece, the end token. Repeated rows are packed each. An empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlight.llm.common import materialize, partitions, ship, slices, text_bytes
from meterlight.llm.encoders import encoder

CAPACITY = 2048
END = 0
PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


def _pieces(path: str, capacity: int):
    @F.pandas_udf(PIECES)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = encoder(path)
        for values in batches:
            out = []
            for _, texts in slices(values):
                ids, counts = codec.encode(texts)
                ids, at = ids.astype("<u4"), 0
                for n in counts.tolist():
                    own = np.append(ids[at : at + n], np.uint32(END)).astype("<u4")
                    at += n
                    out.append(
                        [
                            {
                                "piece": k,
                                "start": first,
                                "length": len(part := own[first : first + capacity]),
                                "ids_crc32": zlib.crc32(part.tobytes()),
                            }
                            for k, first in enumerate(range(0, len(own), capacity))
                        ]
                    )
            yield pd.Series(out)

    return cut


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""
    ship(docs.sparkSession)
    cut = docs.select("doc_id", F.explode(_pieces(path, capacity)(text_bytes())).alias("p"))
    return cut.select("doc_id", "p.*")


# ---- the plan ---------------------------------------------------------------------------


def grouped(counts: dict[int, int], small: int, groups: int) -> list[tuple[int, int]]:
    """Groups of equal cardinality of the lengths above ``small``: (longest, pieces)."""
    large = sorted((n for n in counts if n > small), reverse=True)
    share = max(1, -(-sum(counts[n] for n in large) // max(1, groups)))
    out: list[tuple[int, int]] = []
    taken, group = 0, -1
    for n in large:
        if taken // share > group:
            group = taken // share
            out.append((n, 0))
        out[-1] = (out[-1][0], out[-1][1] + counts[n])
        taken += counts[n]
    return out


def best_filling(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size fills a sequence of greatest value: one more piece each level."""
    best, chosen = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        now, choice = best.copy(), np.full(capacity + 1, -1, np.int64)
        for k, size in enumerate(sizes.tolist()):
            gain = best[: capacity + 1 - size] + values[k]
            better = np.flatnonzero(gain > now[size:] + 1e-12) + size
            now[better] = gain[better - size]
            choice[better] = k
        if (choice < 0).all():
            break
        best = now
        chosen.append(choice)
    filling, room = np.zeros(len(sizes), np.int64), capacity
    for choice in reversed(chosen):
        if choice[room] >= 0:
            filling[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return filling


def configurations(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400
) -> list[tuple[np.ndarray, float]]:
    """Fillings and how often each is used in an optimum of the linear programme."""
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        level = inverse @ demand
        prices = np.ones(len(sizes)) @ inverse
        filling = best_filling(sizes, prices, capacity)
        if prices @ filling <= 1 + 1e-9:
            break
        step = inverse @ filling
        ratio = np.where(step > 1e-12, level / np.where(step > 1e-12, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = filling
    level = np.linalg.inv(basis) @ demand
    return [(basis[:, j].astype(np.int64), max(0.0, x)) for j, x in enumerate(level)]


class Plan:
    """Kinds of equally filled sequences; ``runs`` has (length, copies, a sequence's, kind)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.kinds: list[tuple[int, tuple[tuple[int, int], ...]]] = []  # (sequences, filling)

    def add(self, sequences: int, filling: dict[int, int]) -> None:
        if sequences > 0:
            self.kinds.append((sequences, tuple(sorted(filling.items(), reverse=True))))


#: Shares of the capacity above which a piece is large; the plan with the fewest sequences is taken.
LARGE = (1 / 8, 1 / 3, 4 / 9, 1 / 2)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 96) -> Plan:
    """Fillings of sequences that hold ``counts[n]`` pieces of each length ``n``.

    Rounding up costs room that only small pieces win back. How many pieces should count as
    large depends on the lengths, so each limit of LARGE is planned.
    """
    tries = [_planned(counts, capacity, int(capacity * share), groups) for share in LARGE]
    return min(tries, key=lambda p: sum(sequences for sequences, _ in p.kinds))


def _planned(counts: dict[int, int], capacity: int, small: int, groups: int) -> Plan:
    out = Plan(capacity)
    left = {n: c for n, c in counts.items() if c > 0}
    out.add(left.pop(capacity, 0), {capacity: 1})
    sizes = grouped(left, small, groups)
    shapes: list[list] = []  # [sequences, {length: copies}, room]
    if sizes:
        upper = np.array([n for n, _ in sizes], np.int64)
        demand = np.array([c for _, c in sizes], np.int64)
        lows = [n for n, _ in sizes[1:]] + [small]
        queue = [
            [[n, left[n]] for n in sorted(left, reverse=True) if low < n <= high]
            for high, low in zip(upper.tolist(), lows)
        ]
        for filling, often in configurations(upper, demand.astype(float), capacity):
            often = int(min([often] + [demand[k] // f for k, f in enumerate(filling) if f]))
            demand = demand - often * filling
            shapes += _substituted(queue, filling, often, capacity)
        kept = {n: c for group in queue for n, c in group}
        left = {n: c for n, c in left.items() if n <= small} | kept
    for sequences, filling in _best_fit(shapes, left, capacity):
        out.add(sequences, filling)
    return out


def _substituted(queue, filling: np.ndarray, often: int, capacity: int) -> list[list]:
    """``often`` sequences of one filling, with actual lengths, longest first, in its places."""
    shapes: list[list] = []
    while often > 0:
        used: dict[int, int] = defaultdict(int)
        batch = often
        # As many sequences as each group's next length lasts for; a place of a group whose
        # next length does not last for one sequence takes pieces of several lengths.
        for k in np.flatnonzero(filling):
            f = int(filling[k])
            if queue[k][0][1] >= f:
                batch = min(batch, queue[k][0][1] // f)
            else:
                batch = 1
        for k in np.flatnonzero(filling):
            need = int(filling[k]) * batch
            while need:
                n, c = queue[k][0]
                took = min(need, c)
                used[n] += took
                need -= took
                if took == c:
                    queue[k].pop(0)
                else:
                    queue[k][0][1] = c - took
        shape = {n: c // batch for n, c in used.items()}
        shapes.append([batch, shape, capacity - sum(n * c for n, c in shape.items())])
        often -= batch
    return shapes


def _best_fit(shapes: list[list], counts: dict[int, int], capacity: int):
    """Place the lengths of ``counts``, longest first, into the fullest sequences that fit."""
    rooms: dict[int, list] = {}
    order: list[int] = []

    def put(sequences: int, filling: dict[int, int], room: int) -> None:
        if sequences:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append([sequences, filling, room])

    for shape in shapes:
        put(*shape)
    for n in sorted(counts, reverse=True):
        pieces = counts[n]
        while pieces:
            at = bisect_left(order, n)
            if at == len(order):
                put(-(-pieces // (capacity // n)), {}, capacity)
                continue
            sequences, filling, room = rooms[order[at]].pop()
            if not rooms[order[at]]:
                del rooms[order.pop(at)]
            each = room // n
            full = min(sequences, pieces // each)
            rest = pieces - full * each if full < sequences else 0
            put(full, _with(filling, n, each), room - each * n)
            put(int(rest > 0), _with(filling, n, rest), room - rest * n)
            put(sequences - full - int(rest > 0), filling, room)
            pieces -= full * each + rest
    for own in rooms.values():
        for sequences, filling, _ in own:
            yield sequences, filling


def _with(filling: dict[int, int], n: int, copies: int) -> dict[int, int]:
    return filling | {n: filling.get(n, 0) + copies}


def places(plan: Plan) -> np.ndarray:
    """Runs of places by length and rank: length, rank, copies, sequence, offset, pieces."""
    rank: dict[int, int] = defaultdict(int)
    sequence, out = 0, []
    for sequences, filling in plan.kinds:
        offset = 0
        for n, copies in filling:
            out.append((n, rank[n], copies, sequence, offset, sequences * copies))
            rank[n] += sequences * copies
            offset += n * copies
        sequence += sequences
    return np.array(sorted(out), np.int64).reshape(-1, 6)


# ---- the pieces -------------------------------------------------------------------------


def _placed(table: np.ndarray):
    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        key = n * (1 << 44) + r
        at = np.searchsorted(table[:, 0] * (1 << 44) + table[:, 1], key, side="right") - 1
        run = table[at]
        own = r - run[:, 1]
        return pd.DataFrame(
            {
                "sequence_id": run[:, 3] + own // run[:, 2],
                "offset": run[:, 4] + own % run[:, 2] * n,
            }
        )

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = 96) -> DataFrame:
    """``pieces`` (a stored table with ``doc_id``, ``piece``, ``length``) with their places.

    Adds ``sequence_id`` and ``offset``. The plan is made on the driver from one row for each
    of at most ``capacity`` lengths, and its runs of places go to the executors; their number
    depends on ``capacity`` and ``groups``, not on the number of pieces.
    """
    buckets = max(16, partitions(pieces.sparkSession))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    by_bucket = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    by_length = by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()
    table = places(plan({r["length"]: r["n"] for r in by_length}, capacity, groups=groups))
    before = by_bucket.select(
        "length",
        "bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("r0"),
    )
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    ranked = pieces.withColumn("own", own).join(before, ["length", "bucket"])
    found = _placed(table)(F.col("length"), F.col("r0") + F.col("own") - 1)
    return ranked.withColumn("found", found).select(
        *[c for c in pieces.columns if c != "bucket"], "found.sequence_id", "found.offset"
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents' pieces with their places; the pieces are stored once before packing."""
    return pack(materialize(cut_documents(docs, path, capacity), "pieces"), capacity)
