"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words in a row (a text of one to four words is one shingle), words being runs of other than ASCII
white space in lower case. Its weight in a text is its count times an inverse document frequency between 1 and 2,
``1 + ln(N / df) / ln(N)``; df is the number of documents that hold the shingle. Two texts link if their weighted Jaccard
similarity, sum of minima over sum of maxima, is at least 0.8, and a class is what links reach.

1. Rows are packed into batches. Each batch sends its distinct shingles, with their counts of documents, to the tasks of
   ranges of the hash, and gets back their counts over all batches. A cell (batch, range) holds the sorted hashes as
   Elias and Fano code them; hashes are cut to 20 bits more than the number of characters has, so that about one shingle
   in a million shares its count with another, in a table of any size. A shingle of every document comes to its range's task once for each batch.
2. Texts with the same words are one text, represented by one of its rows. Each representative gets BANDS * ROWS consistent
   weighted samples; two texts agree in one with a probability equal to their similarity. Texts that agree in a whole band
   meet in a bucket: a similarity of 0.8 is missed by all bands with a probability of 0.0006, 0.85 with 0.00003.
3. In each bucket the pairs of a spanning forest, the most alike by their samples first, are verified by the exact
   similarity of the whole texts (fewer pairs than members, not all pairs); connected components follow.
4. Where a bucket still spans several components, members outside its largest one are held against all members
   of the bucket in blocks, by size and samples (MAY_LINK loses another 0.0002 of the pairs at 0.8); every pair between
   components that may link is verified there, once.

Edge cases: null texts and texts without words are classes of their own; equal texts share a class whatever their
number; repeated rows with the same doc_id get one row each
(the smallest class, if their texts differ); null doc_ids are classes of their own; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, batches, connected_components, discard, mix64, settle

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
#: Characters in a batch, those for which one task counts the shingles, and the least of a batch for each range.
BATCH, RANGE, SHARE = 4_000_000, 12_000_000, 1000
#: Two texts whose samples agree less often than this are not verified; at similarity 0.8 that is 3.7 standard deviations.
MAY_LINK = 0.6
#: Members in a block of a bucket that are held against each other in one task.
BLOCK = 512
#: Rows of one text from which on they are dealt to several tasks.
HOT = 10_000
_LEVELS = 4096
_EMPTY = mix64(np.arange(1, WORDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _gamma2(u: np.ndarray) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution by Newton's method."""
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), 1e-9)
    return x


_U = (np.arange(_LEVELS) + 0.5) / _LEVELS
_R = _gamma2(_U).astype(np.float32)
_INVERSE_R = (1 / _gamma2(_U)).astype(np.float32)
_LN_C = np.log(_gamma2(_U)).astype(np.float32)
_BETA = _U.astype(np.float32)
_SEED_A = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SEED_B = mix64(_SEED_A ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


class Shingler:
    """Sorted distinct shingle hashes of texts with their counts."""

    def __init__(self) -> None:
        self.words = WordHasher()
        self.factors = mix64(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, texts: list[str]):
        """For each text (number of words, hash of the word sequence, shingles, counts)."""
        hashes, at = self.words([t.lower() for t in texts])
        n = max(0, len(hashes) - WORDS + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(WORDS):
            rolled += hashes[j : j + n] * self.factors[j]
        rolled = mix64(rolled)
        for a, b in zip(at[:-1], at[1:], strict=True):
            size = int(b - a)
            if size == 0:
                yield 0, (0, 0), rolled[:0], np.zeros(0, np.int64)
                continue
            if size < WORDS:
                one = mix64(np.array([np.bitwise_xor.reduce(mix64(hashes[a:b] + self.factors[:size])) ^ _EMPTY[size - 1]], np.uint64))
                found, count = one, np.ones(1, np.int64)
            else:
                found, count = np.unique(rolled[a : b - WORDS + 1], return_counts=True)
            place = np.arange(size, dtype=np.uint64)
            h1 = int(np.add.reduce(mix64(hashes[a:b] + place)))
            h2 = int(np.add.reduce(mix64(hashes[a:b] * self.factors[0] ^ mix64(place + self.factors[1])))) ^ size
            yield size, (h1, h2), found, count


def sample(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """BANDS * ROWS consistent weighted samples of a weighted set, as 64-bit hashes of (shingle, level)."""
    best = np.full(len(_SEED_A), np.inf, np.float32)
    out = np.zeros(len(_SEED_A), np.uint64)
    lanes = np.arange(len(_SEED_A))
    for low in range(0, len(shingles), 1024):
        part = shingles[low : low + 1024]
        h = (part[:, None] ^ _SEED_A) * _SEED_B
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        first, second, third = (h >> np.uint64(52)).astype(np.intp), ((h >> np.uint64(40)) & np.uint64(_LEVELS - 1)).astype(np.intp), ((h >> np.uint64(28)) & np.uint64(_LEVELS - 1)).astype(np.intp)
        r, beta = _R[first], _BETA[second]
        level = np.floor(np.log(weights[low : low + 1024]).astype(np.float32)[:, None] * _INVERSE_R[first] + beta)
        value = _LN_C[third] - r * (level - beta + np.float32(1))
        at = value.argmin(0)
        least = value[at, lanes]
        take = least < best
        best[take] = least[take]
        picked = mix64(part[at] + level[at, lanes].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[take] = picked[take]
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _inverse(df: np.ndarray, n: int) -> np.ndarray:
    """Weights of shingles that df of n documents hold."""
    return 1 + np.log(max(n, 2) / df) / np.log(max(n, 2))


def _pack(parts):
    """(batch, docs, size, rows): rows are an Arrow stream of row (the batch's number and a place in it), doc_id and text."""
    batch = TaskContext.get().partitionId() << 22
    for part in parts:
        keys, texts = part.column(0), [t or "" for t in part.column(1).to_pylist()]
        # A row's number has 14 bits for its place in the batch.
        for a, b in ((low, min(end, low + (1 << 14))) for start, end in batches(texts, BATCH) for low in range(start, end, 1 << 14)):
            own = pa.record_batch([pa.array(np.arange(b - a) + (batch << 14)), keys.slice(a, b - a), pa.array(texts[a:b], pa.string())], ["row", "doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(own)
            yield pa.record_batch([pa.array([batch]), pa.array([b - a]), pa.array([sum(map(len, texts[a:b]))]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "docs", "size", "rows"])
            batch += 1


def _unpacked(rows: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(rows.as_buffer()).read_all()


def _shingled(shingler: Shingler, texts: list[str]):
    for a, b in batches(texts):
        yield from shingler(texts[a:b])


def _texts(parts):
    for part in parts:
        for rows, wanted in zip(part.column(0), part.column(1).to_pylist(), strict=True):
            df = {w["rep"]: w["df"] for w in wanted}
            own = _unpacked(rows).select(["row", "text"]).combine_chunks()
            keep = [i for i, r in enumerate(own.column("row").to_pylist()) if r in df]
            some = own.take(pa.array(keep, pa.int64()))
            for a, b in batches(some.column("text").to_pylist()):
                piece = some.slice(a, b - a)
                yield pa.record_batch([*(c.combine_chunks() for c in piece.columns), pa.array([df[r] for r in piece.column("row").to_pylist()], pa.binary())], ["rep", "text", "df"])


def _distinct(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(found), return_counts=True)


def code_sorted(values: np.ndarray, bits: int) -> bytes:
    """Elias and Fano's code of sorted distinct numbers below 2^bits: low bits packed, high bits as unary steps."""
    low = max(0, bits - max(1, len(values)).bit_length() + 1)
    kept = np.unpackbits(values.astype(">u8").view(np.uint8)).reshape(len(values), 64)[:, 64 - low :]
    high = (values >> np.uint64(low)).astype(np.int64)
    steps = np.zeros((int(high[-1]) if len(high) else 0) + len(high), np.uint8)
    steps[high + np.arange(len(high))] = 1
    return len(values).to_bytes(4, "little") + np.packbits(kept).tobytes() + np.packbits(steps).tobytes()


def decode_sorted(data: bytes, bits: int) -> np.ndarray:
    """The numbers of code_sorted."""
    n = int.from_bytes(data[:4], "little")
    low = max(0, bits - max(1, n).bit_length() + 1)
    at = 4 + (n * low + 7) // 8
    wide = np.zeros((n, 64), np.uint8)
    wide[:, 64 - low :] = np.unpackbits(np.frombuffer(data[4:at], np.uint8), count=n * low).reshape(n, low)
    steps = np.flatnonzero(np.unpackbits(np.frombuffer(data[at:], np.uint8)))[:n]
    return np.packbits(wide).view(">u8").astype(np.uint64) | ((steps - np.arange(n)).astype(np.uint64) << np.uint64(low))


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts of at least one: a bit for each that is above one, then those."""
    many = counts > 1
    return np.packbits(many).tobytes() + counts[many].astype("<u4").tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    at = (n + 7) // 8
    out = np.ones(n, np.uint32)
    out[np.unpackbits(np.frombuffer(data[:at], np.uint8), count=n).astype(bool)] = np.frombuffer(data[at:], "<u4")
    return out


def _layout(size: int, batches_: int) -> tuple[int, int]:
    """Bits of the ranges and of a cut hash, for a table of so many characters in so many batches."""
    ranges = min(size / RANGE, size / max(1, batches_) / SHARE)
    return max(0, math.ceil(math.log2(max(1, ranges)))), min(64, 20 + max(1, size).bit_length())


def _spread(ranges: int, bits: int):
    """(range, batch, shingles, docs): a batch's sorted distinct shingles by ranges of the hash, with counts of documents."""
    down, mask = np.uint64(64 - bits), np.uint64((1 << (bits - ranges)) - 1)
    bounds = np.arange(1, 1 << ranges, dtype=np.uint64) << np.uint64(bits - ranges)

    def run(parts):
        shingler = Shingler()
        for part in parts:
            for batch, rows in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                shingles, docs = _distinct([s for _, _, s, _ in _shingled(shingler, _unpacked(rows).column("text").to_pylist())])
                cut, first = np.unique(shingles >> down, return_index=True)
                docs = np.add.reduceat(docs, first) if len(first) else docs
                at = np.concatenate([[0], np.searchsorted(cut, bounds), [len(cut)]])
                some = np.flatnonzero(np.diff(at))
                cells = [(code_sorted(cut[at[i] : at[i + 1]] & mask, bits - ranges), _pack_counts(docs[at[i] : at[i + 1]])) for i in some]
                yield pa.record_batch([pa.array(some), pa.array(np.full(len(some), batch)), *(pa.array(c, pa.binary()) for c in (zip(*cells, strict=True) if cells else ([], [])))], ["range", "batch", "shingles", "docs"])

    return run


def _count(width: int):
    def run(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """(range, batch, df): for each batch the counts of its shingles of the range over all batches, in the batch's order."""
        parts = [decode_sorted(x, width) for x in rows["shingles"]]
        found, where = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(where, np.concatenate([_unpack_counts(x, len(p)) for x, p in zip(rows["docs"], parts, strict=True)]), len(found)).astype(np.uint32)
        cells = np.split(total[where], np.cumsum([len(x) for x in parts])[:-1])
        return pd.DataFrame({"range": rows["range"], "batch": rows["batch"], "n": [len(x) for x in cells], "df": [_pack_counts(x) for x in cells]})

    return run


def _frequencies(packed: DataFrame, ranges: int, bits: int) -> DataFrame:
    """(batch, cells): cells are (range, n, df), which in the order of the ranges are the counts of a batch's distinct shingles."""
    spread = packed.select("batch", "rows").mapInArrow(_spread(ranges, bits), "range long, batch long, shingles binary, docs binary")
    counted = spread.groupBy("range").applyInPandas(_count(bits - ranges), "range long, batch long, n long, df binary")
    return counted.groupBy("batch").agg(F.collect_list(F.struct("range", "n", "df")).alias("cells"))


def _known(cells: list) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint32), *(_unpack_counts(c["df"], c["n"]) for c in sorted(cells or [], key=lambda c: c["range"]))])


def _own_weights(df: bytes, counts: np.ndarray, n: int) -> np.ndarray:
    return counts * _inverse(_unpack_counts(df, len(counts)).astype(np.float64), n)


def _sketch(n: int, bits: int):
    names = ["row", "doc_id", "h1", "h2", "samples", "total", "df"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary())
    down = np.uint64(64 - bits)

    def run(parts):
        shingler = Shingler()
        for part in parts:
            for packed, cells in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                rows, known = _unpacked(packed), _known(cells)
                texts = rows.column("text").to_pylist()
                distinct, _ = _distinct([found >> down for _, _, found, _ in _shingled(shingler, texts)])
                out, keep = [], []
                for i, ((size, (h1, h2), found, count), doc_id) in enumerate(zip(_shingled(shingler, texts), rows.column("doc_id").to_pylist(), strict=True)):
                    if size and doc_id is not None:
                        df = _pack_counts(known[np.searchsorted(distinct, found >> down)])
                        own = _own_weights(df, count, n)
                        got = sample(found, own)
                        out.append((h1 - (1 << 63), (h2 & ((1 << 64) - 1)) - (1 << 63), (got >> np.uint64(48)).astype("<u2").tobytes(), float(own.sum()), df))
                        keep.append(i)
                if out:
                    own = rows.select(["row", "doc_id"]).take(pa.array(keep)).combine_chunks().to_batches()[0]
                    yield pa.record_batch([*own.columns, *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    return run


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two weighted sets, given as sorted distinct shingles and weights."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum())
    return low / max(float(a[1].sum() + b[1].sum()) - low, 1e-300)


def _verify(n: int, threshold: float):
    def run(parts):
        shingler = Shingler()

        def of(text, df):
            _, _, found, count = next(iter(shingler([text])))
            return found, _own_weights(df, count, n)

        held, own = None, None
        for part in parts:
            columns = [part.column(i).to_pylist() for i in range(6)]
            keep = []
            for i, (a, _, x, y, df_x, df_y) in enumerate(zip(*columns, strict=True)):
                if a != held:
                    held, own = a, of(x, df_x)
                if weighted_jaccard(own, of(y, df_y)) >= threshold - 1e-9:
                    keep.append(i)
            yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (a, b, slot) whose weighted Jaccard similarity reaches the threshold; texts has (rep, text, df) once for each.

    A text that many pairs share as a is sent once for each slot, and few pairs share an (a, slot).
    """
    left = pairs.select("a", "slot").distinct().join(texts.toDF("a", "text_a", "df_a"), "a")
    full = pairs.join(texts.toDF("b", "text_b", "df_b"), "b").join(left, ["a", "slot"]).select("a", "b", "text_a", "text_b", "df_a", "df_b")
    return full.mapInArrow(_verify(n, threshold), "a long, b long")


def forest(samples: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest (positions) of the pairs whose samples agree at least so often, with the most alike pairs first.

    Where links connect two members, the least alike pair on the forest's way between them is about as alike as the links
    (a maximum spanning tree is a bottleneck tree); so its pairs are the ones to verify.
    """
    n, out = len(samples), []
    best, source = (samples == samples[0]).mean(1), np.zeros(n, np.int64)
    best[0] = -1
    for _ in range(n - 1):
        i = int(best.argmax())
        if best[i] >= least:
            out.append((int(source[i]), i))
        alike = (samples == samples[i]).mean(1)
        closer = (alike > best) & (best >= 0)
        best[closer], source[closer] = alike[closer], i
        best[i] = -1
    return out


def _runs(keys: np.ndarray):
    """(key, positions) of equal neighbours in sorted order."""
    order = np.argsort(keys, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
        if len(part):
            yield keys[part[0]], part


def _forests(least: float):
    def run(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "rep"], ignore_index=True)
        samples, rep, block, out = np.stack([np.frombuffer(s, "<u2") for s in rows["samples"]]), rows["rep"].to_numpy(), rows["block"].to_numpy(), {}
        for _, part in _runs(rows["bucket"].to_numpy()):
            for i, j in forest(samples[part], least):
                out[int(rep[part[i]]), int(rep[part[j]])] = int(block[part[j]])
        return pd.DataFrame([(a, b, slot) for (a, b), slot in sorted(out.items())], columns=["a", "b", "slot"], dtype="int64")

    return run


def _first_pairs(members: DataFrame) -> DataFrame:
    """(a, b, slot) to verify first: spanning forests of buckets; members (bucket, hub, size, rep, samples).

    Small buckets share a task. A larger one is cut into blocks, each of which also holds the bucket's hub, so that no task
    holds more than about BLOCK members of it, and a bucket gives no more pairs than it has members. The hub has the
    smallest number and begins each forest, so that it never is b; at most BLOCK pairs of a bucket share an a and a slot.
    """
    tasks = max(1, -(-members.count() // (8 * BLOCK)))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.when(F.col("rep") == F.col("hub"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), blocks).cast("int")))
    dealt = members.select("bucket", "size", "rep", "samples", F.explode(block).alias("block"))
    task = F.when(F.col("size") <= BLOCK, F.pmod(F.xxhash64("bucket"), F.lit(tasks))).otherwise(F.xxhash64("bucket", "block"))
    pairs = dealt.withColumn("task", task).groupBy("task").applyInPandas(_forests(MAY_LINK), "a long, b long, slot long")
    return pairs.groupBy("a", "b").agg(F.min("slot").alias("slot"))


def _vectors(n: int):
    def run(parts):
        shingler = Shingler()
        for part in parts:
            texts, df = part.column(1).to_pylist(), part.column(2).to_pylist()
            for a, b in batches(texts):
                found = [(s, _own_weights(d, c, n)) for (_, _, s, c), d in zip(shingler(texts[a:b]), df[a:b], strict=True)]
                yield pa.record_batch([part.column(0).slice(a, b - a), pa.array([s.tobytes() for s, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())], ["rep", "shingles", "weights"])

    return run


def similar(shingles: np.ndarray, weights: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarities of one weighted set (sorted) with others, by one search for all of them."""
    sizes = np.array([len(s) for s, _ in others])
    flat, own = np.concatenate([s for s, _ in others]), np.concatenate([w for _, w in others])
    at = np.minimum(np.searchsorted(shingles, flat), len(shingles) - 1)
    low = np.where(shingles[at] == flat, np.minimum(weights[at], own), 0)
    starts = np.cumsum(sizes) - sizes
    shared, total = np.add.reduceat(low, starts), np.add.reduceat(own, starts)
    return shared / (weights.sum() + total - shared)


def _candidates(outside: pd.DataFrame, inside: pd.DataFrame, least: float, threshold: float):
    """(i, may): position of a member outside its bucket's largest part, and those of the members that it may link to.

    They are of other components, of a fitting size and agree in enough samples; a pair that shares several buckets is
    given in the one of the first band that it agrees in.
    """

    def matrix(side: pd.DataFrame) -> np.ndarray:
        return np.stack([np.frombuffer(s, "<u2") for s in side["samples"]])

    if not len(outside) or not len(inside):
        return
    x, y = matrix(outside), matrix(inside)
    comp_x, comp_y, band = outside["component"].to_numpy(), inside["component"].to_numpy(), outside["band"].to_numpy()
    total_x, total_y = outside["total"].to_numpy(), inside["total"].to_numpy()
    groups = dict(_runs(inside["bucket"].to_numpy()))
    for bucket, part in _runs(outside["bucket"].to_numpy()):
        own = groups.get(bucket)
        for i in part if own is not None else ():
            fits = (comp_y[own] != comp_x[i]) & (np.minimum(total_y[own], total_x[i]) >= (threshold - 1e-6) * np.maximum(total_y[own], total_x[i]))
            may = own[fits]
            same = y[may] == x[i]
            may, same = may[same.mean(1) >= least], same[same.mean(1) >= least]
            may = may[same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[i]]
            if len(may):
                yield i, may


def _partners(least: float, threshold: float):
    """(bucket, rep) of the members that stand in some candidate pair."""

    def run(_key: tuple, outside: pd.DataFrame, inside: pd.DataFrame) -> pd.DataFrame:
        out = set()
        for i, may in _candidates(outside, inside, least, threshold):
            bucket = int(outside["bucket"].iat[i])
            out.add((bucket, int(outside["rep"].iat[i])))
            out |= {(bucket, int(r)) for r in inside["rep"].to_numpy()[may]}
        return pd.DataFrame(sorted(out), columns=["bucket", "rep"], dtype="int64")

    return run


def _across(least: float, threshold: float):
    """Links between components: the candidate pairs whose exact similarity reaches the threshold."""

    def run(_key: tuple, outside: pd.DataFrame, inside: pd.DataFrame) -> pd.DataFrame:
        out = set()
        rep_x, rep_y, shingles, weights = outside["rep"].to_numpy(), inside["rep"].to_numpy(), inside["shingles"].to_list(), inside["weights"].to_list()
        for i, may in _candidates(outside, inside, least, threshold):
            own = np.frombuffer(outside["shingles"].iat[i], np.uint64), np.frombuffer(outside["weights"].iat[i])
            for low in range(0, len(may), 256):
                some = may[low : low + 256]
                alike = similar(*own, [(np.frombuffer(shingles[j], np.uint64), np.frombuffer(weights[j])) for j in some])
                out |= {(int(min(rep_x[i], rep_y[j])), int(max(rep_x[i], rep_y[j]))) for j in some[alike >= threshold - 1e-9]}
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    return run


def _residual(members: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b): the links between components within a bucket.

    Buckets of two are settled by their forest. Small buckets share a task; in a larger one the members outside its largest
    component are cut into blocks and all members into cells, and each pair of a block and a cell is a task, so that no task holds
    more than about BLOCK members of it on a side: a member is copied as often as there are blocks of outsiders. A first pass
    over the samples finds the members with a partner; only their shingles are shuffled for the exact pass.
    """
    known = members.where("size > 2").join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = known.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    spans = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top")).where("parts > 1")
    known = known.join(spans.select("bucket", F.col("top.component").alias("star"), F.col("top.n").alias("inside")), "bucket")
    open_ = settle(known.withColumn("outside", F.col("size") - F.col("inside")).drop("inside", "hub").join(reps.select("rep", "total"), "rep"), "open")
    blocks, cells = F.ceil(F.col("outside") / BLOCK).cast("int"), F.ceil(F.col("size") / BLOCK).cast("int")

    def cogroup(rows: DataFrame, run, schema: str) -> DataFrame:
        tasks = max(1, -(-rows.count() // (2 * BLOCK)))
        small = F.when(F.col("size") <= BLOCK, F.pmod(F.xxhash64("bucket"), F.lit(tasks)))
        cols = ["task", *(c for c in rows.columns if c not in ("size", "star", "outside"))]

        def dealt(side: DataFrame, block, cell) -> DataFrame:
            wide = side.withColumn("block", block).withColumn("cell", cell)
            return wide.withColumn("task", F.coalesce(small, F.xxhash64("bucket", "block", "cell"))).select(cols).toDF(*cols)

        left = dealt(rows.where("component <> star"), F.pmod(F.xxhash64("rep"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), cells - 1)))
        right = dealt(rows, F.explode(F.sequence(F.lit(0), blocks - 1)), F.pmod(F.xxhash64("rep"), cells).cast("int"))
        return left.groupBy("task").cogroup(right.groupBy("task")).applyInPandas(run, schema).distinct()

    paired = settle(cogroup(open_, _partners(MAY_LINK, threshold), "bucket long, rep long"), "paired")
    vectors = texts.join(paired.select("rep").distinct(), "rep", "left_semi").mapInArrow(_vectors(n), "rep long, shingles binary, weights binary")
    rows = settle(open_.join(paired, ["bucket", "rep"], "left_semi").join(vectors, "rep"), "paired_rows")
    found = settle(cogroup(rows, _across(MAY_LINK, threshold), "a long, b long"), "more")
    discard(open_, paired, rows)
    return found


def _class_of_rows(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every sketched row; classes (h1, h2, n, class_id) has each text once.

    Texts of more than HOT rows are spread over n / HOT salts, so that no task gets all the rows of one text. There
    are at most N / HOT such texts, 24 bytes each, which are broadcast.
    """
    salts = F.ceil(F.col("n") / HOT).cast("int")
    hot = classes.where(F.col("n") > HOT).select("h1", "h2", salts.alias("salts"))
    rows = sketches.select("doc_id", "h1", "h2", "row").join(F.broadcast(hot), ["h1", "h2"], "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int"))
    return salted.join(classes.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), ["h1", "h2", "salt"]).select("doc_id", "class_id")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (smallest doc_id of the class), kept (doc_id = class_id)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = settle(rows.mapInArrow(_pack, "batch long, docs long, size long, rows binary"), "packed")
    n, size, count = (x or 0 for x in packed.agg(F.sum("docs"), F.sum("size"), F.count("*")).first())
    ranges, bits = _layout(size, count)
    joined = packed.select("batch", "rows").join(_frequencies(packed, ranges, bits), "batch", "left").select("rows", "cells")
    sketches = settle(joined.mapInArrow(_sketch(n, bits), "row long, doc_id long, h1 long, h2 long, samples binary, total double, df binary"), "sketches")
    one = F.min(F.struct("row", "samples", "total", "df")).alias("one")
    groups = sketches.groupBy("h1", "h2").agg(one, F.min("doc_id").alias("least"), F.count("*").alias("n"))
    reps = settle(groups.select("h1", "h2", "least", "n", F.col("one.row").alias("rep"), "one.samples", "one.total", "one.df"), "reps")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("samples", 2 * ROWS * i + 1, F.lit(2 * ROWS))))
    banded = reps.select("rep", F.posexplode(bands).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    joined = banded.join(shared, "bucket").select("bucket", "band", "hub", F.col("n").alias("size"), "rep")
    members = settle(joined.join(reps.select("rep", "samples"), "rep"), "members")
    wanted = reps.join(members.select("rep").distinct(), "rep", "left_semi").groupBy(F.shiftright("rep", 14).alias("batch")).agg(F.collect_list(F.struct("rep", "df")).alias("wanted"))
    texts = settle(packed.select("batch", "rows").join(wanted, "batch").select("rows", "wanted").mapInArrow(_texts, "rep long, text string, df binary"), "texts")
    discard(packed)
    forests = settle(_first_pairs(members), "forests")
    links = settle(verified(forests, texts, n, threshold), "links")
    discard(forests)
    labels = connected_components(links).toDF("rep", "component").checkpoint()
    more = _residual(members, labels, reps, texts, n, threshold)
    if not more.isEmpty():
        labels = connected_components(links.union(more)).toDF("rep", "component").checkpoint()
    discard(texts, members, links, more)
    owned = reps.select("h1", "h2", "n", "least", "rep").join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = owned.groupBy("component").agg(F.min("least").alias("class_id"))
    classes = _class_of_rows(sketches, owned.join(least, "component").select("h1", "h2", "n", "class_id")).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = rows.select("doc_id").join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one of each class, the smallest doc_id's; rows with a null doc_id all stay.

    Of rows that repeat a kept doc_id one stays. Texts are shuffled once, by doc_id.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    own = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("key"))
    one = own.join(kept, F.col("key") == F.col("kept_id"), "left_semi").dropDuplicates(["key"])
    return one.union(own.where("key is null")).select("doc.*")
