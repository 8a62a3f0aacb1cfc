"""Vector code compression: product codes whose codebooks are fitted by Lloyd's rounds with Hamerly's bounds, all in integers.

Components become floor(256 * c); a vector is cut into PARTS equal parts (if its length allows no equal ones, the first are one longer),
each with a codebook of ENTRIES entries, which starts as that part of the vectors with the smallest ids.

State of a round, written and read again: for each vector the index of each part's entry, an upper bound of the distance to it and
a lower bound of the distance to the second nearest. After the entries moved, the upper bound grows by what its own entry moved, the
lower one shrinks by the most that any other did. An entry stays the nearest without a look at the others if the upper bound is
strictly below the larger of the lower bound and half the distance between the entry and its nearest neighbour in the codebook. If
not, the exact distance takes the place of the upper bound; if that fails as well, all entries are scanned in integers. As bounds must
hold strictly and are rounded outwards, a tie always goes to the scan, which takes the lower index.

A task adds the parts and counts of each entry while it assigns them; these partial sums are merged on executors, and the
driver computes floor(sum / count), a few thousand integers for each vector length.

Edge cases: null, empty and non-finite vectors are dropped; vectors of each length have codebooks of their own; with fewer vectors
than entries a codebook is as short; rows with a null vec_id come last in the order that starts the codebooks, repeated ids come in the
order of their packed vectors; null labels are one group over all lengths; components beyond 2^62 / 256 in size are clipped;
an error beyond 64 bits is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, settle
from .integers import by_length, merged, pack, partial, scaled, unpack, whole_vectors

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows that a task holds as 64-bit integers at once.
ROWS = 4096


def _up(v: np.ndarray) -> np.ndarray:
    return np.nextafter(v.astype(np.float32), np.float32(np.inf))


def _down(v: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(v.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as 64-bit integers if squared distances between them fit these, else as Python integers."""
    bound = max((int(np.abs(a).max(initial=0)) for a in arrays), default=0)
    width = max(a.shape[-1] for a in arrays)
    kind = np.int64 if 8 * bound * bound * max(width, 1) < 1 << 62 else object
    return [a.astype(kind) for a in arrays]


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows (rows) to entries (columns)."""
    x, book = exact(x, book)
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)


def own_distance(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the entry beside it."""
    x, entries = exact(x, entries)
    return ((x - entries) ** 2).sum(1)


def cuts(dims: int, parts: int = PARTS) -> list[np.ndarray]:
    return np.array_split(np.arange(dims), parts)


class Codebooks:
    """The entries of all parts, with how far each moved in the last round."""

    def __init__(self, books: list[np.ndarray], before: list[np.ndarray] | None = None) -> None:
        self.books, self.moved = books, None
        self.half, self.most = [], []
        if before is not None:
            self.moved = [np.sqrt(own_distance(new, old).astype(np.float64)) for new, old in zip(books, before, strict=True)]
        for i, book in enumerate(books):
            apart = distances(book, book).astype(np.float64)
            np.fill_diagonal(apart, np.inf)
            self.half.append(np.sqrt(apart.min(1)) / 2)
            if self.moved is not None:
                # The most that any other entry moved.
                order = np.argsort(-self.moved[i], kind="stable")
                most = np.full(len(book), self.moved[i][order[0]])
                most[order[0]] = self.moved[i][order[1]] if len(order) > 1 else 0.0
                self.most.append(most)

    def assign(self, i: int, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings code and bounds of part i up to date in place; returns how many rows were scanned."""
        book, todo = self.books[i], np.arange(len(x))
        if self.moved is not None:
            upper[:] = _up(upper.astype(np.float64) + self.moved[i][code])
            lower[:] = _down(lower.astype(np.float64) - self.most[i][code])
            limit = np.maximum(lower, _down(self.half[i])[code])
            todo = np.flatnonzero(~(upper < limit))
            upper[todo] = _up(np.sqrt(own_distance(x[todo], book[code[todo]]).astype(np.float64)))
            todo = todo[~(upper[todo] < limit[todo])]
        if len(todo):
            square = distances(x[todo], book)
            near = square.argmin(1)
            code[todo] = near
            upper[todo] = _up(np.sqrt(square[np.arange(len(todo)), near].astype(np.float64)))
            if len(book) > 1:
                second = np.partition(square, 1, axis=1)[:, 1]
                lower[todo] = _down(np.sqrt(second.astype(np.float64)))
            else:
                lower[todo] = np.inf
        return len(todo)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for book in self.books for row in book for v in row).encode()).hexdigest()


def _pack(parts):
    for part in parts:
        for d, rows in by_length(part):
            packed = pa.array(pack(scaled(rows.column("embedding"), SCALE)), pa.binary())
            yield pa.record_batch([rows.column("vec_id"), rows.column("label"), rows.column("dims"), packed], ["vec_id", "label", "dims", "x"])


def _entry_sums(cut: list[np.ndarray], x: np.ndarray, code: np.ndarray, sizes: list[int]) -> dict[str, object]:
    """Sums and counts of each entry's parts, as Python integers."""
    out: dict[str, object] = {"scanned": 0, "kept": 0}
    for i, c in enumerate(cut):
        at = code[:, i].astype(np.int64)
        part = x[:, c]
        if int(np.abs(part).max(initial=0)) * max(len(x), 1) >= 1 << 62:
            part = part.astype(object)
        total = np.zeros((sizes[i], len(c)), part.dtype)
        np.add.at(total, at, part)
        out[f"sum{i}"], out[f"count{i}"] = total.astype(object), np.bincount(at, minlength=sizes[i])
    return out


def _round(books, first: bool):
    """New codes and bounds of all rows, then one row with the sums of this partition for each vector length."""

    def run(parts):
        totals: dict[int, dict] = {}
        for part in parts:
            for d, rows in by_length(part):
                known, cut = books.value[d], cuts(d)
                for low in range(0, rows.num_rows, ROWS):
                    piece = rows.slice(low, ROWS)
                    x, size = unpack(piece.column("x").to_pylist(), d), piece.num_rows
                    if first:
                        code, upper, lower = np.zeros((size, PARTS), np.uint8), np.zeros((size, PARTS), np.float32), np.zeros((size, PARTS), np.float32)
                    else:
                        code, upper, lower = (np.frombuffer(b"".join(piece.column(name).to_pylist()), kind).reshape(size, PARTS).copy() for name, kind in (("code", np.uint8), ("upper", np.float32), ("lower", np.float32)))
                    scanned = sum(known.assign(i, x[:, c], code[:, i], upper[:, i], lower[:, i]) for i, c in enumerate(cut))
                    sums = _entry_sums(cut, x, code, [len(b) for b in known.books])
                    sums["scanned"], sums["kept"] = scanned, size * PARTS - scanned
                    totals[d] = {k: totals[d][k] + sums[k] for k in sums} if d in totals else sums
                    packed = [pa.array([r.tobytes() for r in v], pa.binary()) for v in (code, upper, lower)]
                    none = pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())
                    yield pa.record_batch([*piece.select(["vec_id", "label", "dims", "x"]).columns, *packed, *none], ["vec_id", "label", "dims", "x", "code", "upper", "lower", "part", "sums"])
                    label = piece.schema.field("label").type
        for d, sums in totals.items():
            row = partial(d, sums)
            empty = [pa.nulls(1, t) for t in (pa.int64(), label)]
            yield pa.record_batch([*empty, row.column("dims"), *(pa.nulls(1, pa.binary()) for _ in range(4)), row.column("part"), row.column("sums")], ["vec_id", "label", "dims", "x", "code", "upper", "lower", "part", "sums"])

    return run


def _errors(books):
    """vec_id, label, code in hexadecimal, exact error and the digest of the codebooks."""

    def run(parts):
        for part in parts:
            for d, rows in by_length(part):
                known, sha = books.value[d]
                for low in range(0, rows.num_rows, ROWS):
                    piece = rows.slice(low, ROWS)
                    x, size = unpack(piece.column("x").to_pylist(), d), piece.num_rows
                    code = np.frombuffer(b"".join(piece.column("code").to_pylist()), np.uint8).reshape(size, PARTS)
                    error = [0] * size
                    for i, c in enumerate(cuts(d)):
                        error = [e + int(v) for e, v in zip(error, own_distance(x[:, c], known.books[i][code[:, i]]), strict=True)]
                    fits = pa.array([e if e < 1 << 63 else None for e in error], pa.int64())
                    yield pa.record_batch([piece.column("vec_id"), piece.column("label"), pa.array([r.tobytes().hex() for r in code], pa.string()), fits, pa.array([sha] * size, pa.string())], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return run


def _updated(book: np.ndarray, sums: np.ndarray, count: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each entry; entries without parts stay."""
    out = book.copy()
    for j in np.flatnonzero(count):
        out[j] = [int(s) // int(count[j]) for s in sums[j]]
    return out


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row for each remaining row: vec_id, code, error, label_error, codebooks_sha256."""
    spark, kind = vectors.sparkSession, vectors.schema["label"].dataType
    known = [T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("dims", T.IntegerType()), T.StructField("x", T.BinaryType())]
    bounds = [T.StructField(name, T.BinaryType()) for name in ("code", "upper", "lower")]
    sums = [T.StructField("part", T.IntegerType()), T.StructField("sums", T.BinaryType())]
    whole = whole_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"))
    rows = settle(whole.select("vec_id", "label", F.size("embedding").alias("dims"), "embedding").mapInArrow(_pack, T.StructType(known)), "vectors")
    books: dict[int, Codebooks] = {}
    for r in rows.select("dims").distinct().collect():
        start = rows.where(F.col("dims") == r["dims"]).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
        x = unpack([bytes(s["x"]) for s in start], r["dims"])
        books[r["dims"]] = Codebooks([x[:, c] for c in cuts(r["dims"])])
    state = rows
    for turn in range(rounds + 1):
        sent = spark.sparkContext.broadcast(books)
        found = settle(state.mapInArrow(_round(sent, turn == 0), T.StructType(known + bounds + sums)), "state")
        discard(state)
        state = found.where("sums is null")
        if turn < rounds:
            for d, total in merged(found.where("sums is not null").select("dims", "part", "sums")).items():
                before = books[d].books
                books[d] = Codebooks([_updated(b, total[f"sum{i}"], total[f"count{i}"]) for i, b in enumerate(before)], before)
    last = spark.sparkContext.broadcast({d: (b, b.digest()) for d, b in books.items()})
    out = state.select("vec_id", "label", "dims", "x", "code").mapInArrow(_errors(last), T.StructType([*known[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())]))
    out = settle(out, "errors")
    discard(found)
    by_label = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = out.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
