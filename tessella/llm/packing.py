"""Packing documents into sequences of a fixed number of tokens by bin completion.

Every document's ids and its end id are cut into pieces of at most ``capacity`` ids, and pieces are put into as few
sequences as possible. Full pieces are sequences of their own. The others are dealt at random into groups of about
GROUP pieces, so that no task ever holds more. A group reopens its emptiest sequences, and the pieces in them are packed again
with those of FAN - 1 other groups, up a tree to one group, so that groups lose no sequences to their edges.

In a group, branch and bound over bin completions: the largest piece left opens a sequence; its fillings, of any number of
pieces, are tried from the least waste on. A filling is left out only if another dominates it: one that has a piece x in
place of some pieces that fit into x together. A branch ends once its waste exceeds what the incumbent
allows. The first incumbent is best-fit decreasing; the search first keeps what it filled to the brim, then opens
everything. The search of a group ends after STEPS steps with the best packing found; without a bound on the steps it is exact.

Edge cases: null and empty texts are one piece, the end id; repeated rows are separate documents; null doc_ids stay
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, settle
from .tokens import encoder

#: Pieces in a group, and groups whose reopened pieces make a group of the next round.
GROUP, FAN = 8192, 16
#: Pieces that the search of a group may try.
STEPS = 50_000


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sequences of positions: each piece, from the largest on, goes where it leaves the least room."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in order:
        k = bisect_left(room, (sizes[i], -1))
        if k == len(room):
            bins.append([i])
            left = (capacity - sizes[i], len(bins) - 1)
        else:
            free, b = room.pop(k)
            bins[b].append(i)
            left = (free - sizes[i], b)
        insort(room, left)
    return bins


class _Pool:
    """Counts of sizes, and the bit set of the sizes there are."""

    def __init__(self, sizes: list[int], capacity: int, steps: int | None) -> None:
        self.count, self.up, self.steps = [0] * (capacity + 1), 0, math.inf if steps is None else steps
        for s in sizes:
            self.put(s)

    def put(self, s: int) -> None:
        self.count[s] += 1
        self.up |= 1 << s

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            self.up ^= 1 << s

    def exactly(self, total: int):
        """All fillings of that sum, their pieces in falling order; nothing is taken."""
        chosen: list[int] = []
        used: dict[int, int] = {}
        left, most = total, total
        while self.steps > 0:
            self.steps -= 1
            if not left:
                yield tuple(chosen)
                most = 0
            able = self.up & ((2 << min(left, most)) - 1)
            x = able.bit_length() - 1
            while x > 0 and used.get(x, 0) >= self.count[x]:
                able ^= 1 << x
                x = able.bit_length() - 1
            if x > 0:
                chosen.append(x)
                used[x] = used.get(x, 0) + 1
                left, most = left - x, x
            elif chosen:
                x = chosen.pop()
                used[x] -= 1
                left, most = left + x, x - 1
            else:
                return

    def dominated(self, filling: tuple[int, ...], waste: int) -> bool:
        """Whether some piece outside could stand for pieces of the filling (or for none) that fit into it together."""
        one, two = 1, 0
        single = 0
        for s in filling:
            two |= (two << s) | (single << s)
            one |= one << s
            single |= 1 << s
        reach, width = one << 1, 1
        while width < waste:
            step = min(width, waste - width)
            reach |= reach << step
            width += step
        rest = self.up
        for s in set(filling):
            if filling.count(s) >= self.count[s]:
                rest &= ~(1 << s)
        return bool((reach if waste else 0) & rest or two & rest)

    def fillings(self, room: int):
        """The undominated fillings of the room, from the least waste on."""
        if not self.up & ((2 << room) - 1):
            yield ()
            return
        if self.up >> room & 1:
            yield (room,)
            return
        for total in range(room, 0, -1):
            for found in self.exactly(total):
                if not self.dominated(found, room - total):
                    yield found


def least_sequences(sizes: list[int], capacity: int) -> int:
    """A lower bound of the sequences needed: pieces above half the capacity stand apart, and what they leave is all that
    pieces of at least k may use beside pieces of at most capacity - k."""
    x = np.sort(np.asarray(sizes, np.int64))
    if not len(x):
        return 0
    below = np.concatenate([[0], np.cumsum(x)])
    half = np.searchsorted(x, capacity // 2, "right")
    k = np.unique(np.append(x[:half], 0))
    low, high = np.searchsorted(x, k), np.searchsorted(x, capacity - k, "right")
    high = np.maximum(high, half)
    spare = (high - half) * capacity - (below[high] - below[half])
    more = np.maximum(0, -(-(below[half] - below[low] - spare) // capacity))
    return int((len(x) - half + more).max())


def bin_completion(sizes: list[int], capacity: int, steps: int | None = STEPS) -> tuple[list[list[int]], bool]:
    """Sequences of positions, and whether no packing has fewer; steps None searches to the end."""
    best, least = best_fit_decreasing(sizes, capacity), least_sequences(sizes, capacity)
    if len(best) <= least:
        return best, True
    loose = [b for b in best if sum(sizes[i] for i in b) < capacity]
    if len(loose) < len(best):
        brim = [b for b in best if sum(sizes[i] for i in b) == capacity]
        own = sorted(i for b in loose for i in b)
        found, _ = search([sizes[i] for i in own], capacity, len(loose), least - len(brim), None if steps is None else steps // 2)
        if found is not None:
            best = brim + [[own[k] for k in b] for b in found]
    found, whole = search(sizes, capacity, len(best), least, steps)
    best = best if found is None else found
    return best, whole or len(best) <= least


def search(sizes: list[int], capacity: int, incumbent: int, least: int, steps: int | None) -> tuple[list[list[int]] | None, bool]:
    """Branch and bound over bin completions: a packing of fewer sequences than the incumbent or None, and whether the search ended."""
    if incumbent <= least or not sizes:
        return None, True
    total = sum(sizes)
    pool, spare = _Pool(sizes, capacity, steps), (incumbent - 1) * capacity - total
    chosen: list[tuple[int, ...]] = []
    stack, waste, found = [], [0], None
    while pool.steps > 0:
        if not pool.up and len(stack) == len(chosen):
            found, spare = list(chosen), (len(chosen) - 1) * capacity - total
            if len(found) <= least:
                break
        elif len(stack) == len(chosen):
            top = pool.up.bit_length() - 1
            pool.take(top)
            stack.append((top, pool.fillings(capacity - top)))
        while stack:
            top, options = stack[-1]
            if len(chosen) == len(stack):
                for s in chosen.pop()[1:]:
                    pool.put(s)
                waste.pop()
            pool.steps -= 1
            option = next(options, None)
            lost = math.inf if option is None else waste[-1] + capacity - top - sum(option)
            if lost > spare:
                stack.pop()
                pool.put(top)
                continue
            for s in option:
                pool.take(s)
            chosen.append((top, *option))
            waste.append(lost)
            break
        if not stack:
            break
    ended = pool.steps > 0
    if found is None:
        return None, ended
    own: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        own.setdefault(sizes[i], []).append(i)
    return [[own[s].pop() for s in one] for one in found], ended


def _pieces(name: str, end: int, capacity: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row", *["ids"] * with_ids]

    def run(parts):
        enc, row = encoder(name), TaskContext.get().partitionId() << 36
        for part in parts:
            keys, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            for a, b in batches(texts):
                ids, at = enc.encode(texts[a:b])
                out = []
                for key, x, y in zip(keys[a:b], at[:-1], at[1:], strict=True):
                    own = np.append(ids[x:y], end).astype("<u4")
                    for piece, low in enumerate(range(0, len(own), capacity)):
                        raw = own[low : low + capacity].tobytes()
                        out.append((key, piece, low, len(raw) // 4, zlib.crc32(raw), row, *[raw] * with_ids))
                        row += 1
                yield pa.record_batch([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names)

    return run


def cut(docs: DataFrame, vocabulary: str, end: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row): pieces of at most capacity ids; row numbers the rows."""
    schema = "doc_id long, piece long, start long, length long, ids_crc32 long, row long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(vocabulary, end, capacity, with_ids), schema)


def _reopened(bins: list[list[int]], sizes: list[int], capacity: int) -> set[int]:
    """The emptiest sequences, with about GROUP / FAN pieces at most."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    out, pieces = set(), 0
    for k in sorted(range(len(bins)), key=lambda k: fill[k]):
        pieces += len(bins[k])
        if fill[k] == capacity or pieces > (GROUP // FAN if out else GROUP // 2):
            break
        out.add(k)
    return out


def _pack(capacity: int, level: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        sizes = rows["length"].tolist()
        bins, _ = bin_completion(sizes, capacity)
        open_ = set() if last else _reopened(bins, sizes, capacity)
        flat = [i for b in bins for i in b]
        out = rows.iloc[flat].drop(columns=["sequence_id", "offset"])
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        out["offset"] = out.groupby(number)["length"].cumsum() - out["length"]
        out["sequence_id"] = pd.array((level << 56) + (int(key[0]) << 20) + number, "Int64")
        out.loc[np.isin(number, list(open_)), "sequence_id"] = pd.NA
        return out[rows.columns]

    return run


def pack(docs: DataFrame, vocabulary: str, end: int, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): every piece and its place.

    Texts are not shuffled; what is shuffled by group is a row of a few integers for each piece (and the ids, if
    with_ids asks for them).
    """
    pieces = settle(cut(docs, vocabulary, end, capacity, with_ids), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity)
    groups, level, done = max(1, math.ceil(rest.count() / GROUP)), 0, [full.select(names)]
    rest = rest.withColumns({"part": F.pmod(F.xxhash64("row"), F.lit(groups)), "sequence_id": F.lit(None).cast("long"), "offset": F.lit(0).cast("long")})
    while True:
        packed = settle(rest.groupBy("part").applyInPandas(_pack(capacity, level, groups == 1), rest.schema), f"packed{level}")
        done.append(packed.where("sequence_id is not null").select(names))
        if groups == 1:
            break
        groups, level = math.ceil(groups / FAN), level + 1
        rest = packed.where("sequence_id is null").withColumn("part", F.pmod("part", F.lit(groups)))
    out = reduce(DataFrame.unionByName, done)
    return out.withColumn("piece", F.col("piece").cast("int"))
