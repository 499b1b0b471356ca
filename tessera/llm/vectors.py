"""Problem 4: most similar vectors for every vector.

Collision counting on single projections, in two places.

* Which vectors meet.  A table has ``m`` random orthonormal single projections;
  a vector's ``TOPS`` farthest ones, by sign, are its marks, and every two of them
  name an array.  Two vectors meet where they collide on two single projections at
  least.  There are ``TABLES`` tables, so a vector travels nine times, however many
  there are: m grows with the data instead, from 4 to 64, to keep arrays near
  ``ARRAY`` vectors.
* Which are compared.  In an array every vector is a query.  Each of ``COUNTED``
  projections is sorted, the query's window on it is centred on the query, and the
  vectors in at least ``NEEDED`` of the windows are verified by their dot product.
  Windows begin narrow where the array is dense and widen (virtual rehashing) for
  the queries that are short of k; their width follows from the wanted cosine.  The
  windows are differences of prefix bit sets of the sorted order and are added up
  in bit slices, so 64 vectors are counted at a time.

Vectors travel as unit vectors in 16-bit fixed point (cosine error below 0.00002).
A pair that meets in several arrays is reported by the first.  Arrays of more than
``LARGE`` vectors are compared in pairs of blocks by several tasks; the list of
them has an entry an array at most, 24,192 in all.  Of a direction that many ids
share only the k + 1 smallest ids travel; the others take their neighbours from
those, so a group of copies that holds a third of all rows costs its rows.

The k best of every vector, whatever their cosine, come from all pairs of blocks
(``neighbours``): where the fifth best lies near 0.6, windows wide enough to hold
it hold a large share of all vectors.

Vectors that are null, all zero, with a null or non-finite element, or of
another length take no part.  An id counts once; if it comes with several
vectors, its best cosine to each other id counts.  Ties in the cosine go to the
smaller id.  Other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIM, K_BEST, MIN_COSINE = 64, 5, 0.9
TABLES, TOPS, ARRAY, LARGE = 3, 3, 768, 4096
COUNTED, NEEDED, SPREAD, STEP = 24, 20, 2.5, 8  # a pair as near as wanted is in fewer than 20 of 24 such windows twice in 100,000
HOT_COPIES, HOT_SHARE = 64, 100_000  # a direction of more ids than both 64 and 1 / 100,000 of all: 100,000 of them at most
TILE, BLOCK = 1024, 32_768
_CODES = "array int, x int, y int, block int, vec_id bigint, code binary"
_PAIRS = "a bigint, b bigint, cosine double"


def _unit(column, dim: int):
    """(rows that take part, their unit vectors) of an Arrow list column."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == dim)
    flat = column.take(rows).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((flat * flat).sum(axis=1))
    fine = np.isfinite(norm) & (norm > 0)
    return rows[fine], flat[fine] / norm[fine, None]


@functools.lru_cache(maxsize=64)
def projections(seed: int, table: int, dim: int, m: int) -> np.ndarray:
    """m orthonormal single projections, as columns."""
    return np.linalg.qr(np.random.default_rng([seed, table]).normal(size=(dim, dim)))[0][:, :m]


def plan(count: int, dim: int, array: int = ARRAY) -> int:
    """Projections a table, so that an array holds about ``array`` of ``count`` vectors; ``dim`` at most."""
    names = TOPS * (TOPS - 1) / 2 * count / array  # 2 m (m - 1) arrays share them
    return int(min(dim, max(TOPS + 1, np.ceil((1 + np.sqrt(1 + 2 * names)) / 2))))


def arrays_of(x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Ascending numbers of the arrays of each vector: one for every two of its marks in a table."""
    out = []
    for t, a in enumerate(tables):
        p = x @ a
        far = np.argpartition(-np.abs(p), TOPS - 1, axis=1)[:, :TOPS]
        marks = np.sort(far * 2 + (np.take_along_axis(p, far, axis=1) > 0), axis=1)
        size = 2 * a.shape[1]
        out += [(t * size + marks[:, i]) * size + marks[:, j] for i in range(TOPS) for j in range(i + 1, TOPS)]
    return np.sort(np.stack(out, axis=1), axis=1).astype(np.int32)


def _add(planes: list[list[np.ndarray]], bits: np.ndarray, weight: int = 0) -> None:
    """Add one bit a counter; ``planes[w]`` holds bits worth 2 ** w that are still to be summed."""
    while len(planes) <= weight:
        planes.append([])
    planes[weight].append(bits)
    if len(planes[weight]) == 3:
        a, b, c = planes[weight]
        odd = a ^ b
        planes[weight] = [odd ^ c]
        _add(planes, (a & b) | (odd & c), weight + 1)


def _at_least(planes: list[list[np.ndarray]], least: int) -> np.ndarray:
    """Bits of the counters that have reached ``least``."""
    digits, w = [], 0
    while w < len(planes):
        if len(planes[w]) == 2:
            a, b = planes[w]
            planes[w] = [a ^ b]
            _add(planes, a & b, w + 1)
        digits.append(planes[w][0] if planes[w] else None)
        w += 1
    # From the top digit: greater so far, or equal so far.
    greater, equal = None, None
    for w in reversed(range(max(len(digits), least.bit_length()))):
        digit = digits[w] if w < len(digits) else None
        if least >> w & 1:
            equal = (np.zeros_like(digits[0]) if digit is None else digit) if equal is None else equal & (0 if digit is None else digit)
        elif digit is not None:
            more = digit if equal is None else equal & digit
            greater = more if greater is None else greater | more
            equal = ~digit if equal is None else equal & ~digit
    return equal if greater is None else greater | equal


class Windows:
    """Single projections of the vectors of one array, sorted, with bit sets of the prefixes of their order.

    A prefix is kept every ``STEP`` vectors; windows are rounded outwards to them.
    """

    def __init__(self, unit: np.ndarray, seed: int = 11):
        n = len(unit)
        self.words = -(-n // 64)
        self.values = (unit @ projections(seed, 1 << 20, unit.shape[1], min(COUNTED, unit.shape[1])).astype(np.float32)).T.copy()
        self.needed = -(-NEEDED * len(self.values) // COUNTED)
        self.order = np.argsort(self.values, axis=1)
        self.sorted = np.take_along_axis(self.values, self.order, axis=1)
        bit = np.uint64(1) << (np.arange(n, dtype=np.uint64) & np.uint64(63))
        self.prefix = np.zeros((len(self.order), -(-n // STEP) + 1, self.words), np.uint64)
        each = np.arange(len(self.order))[:, None]
        for o in range(STEP):
            part = self.order[:, o::STEP]
            self.prefix[each, np.arange(1, part.shape[1] + 1)[None, :], part >> 6] |= bit[part]
        np.bitwise_or.accumulate(self.prefix, axis=1, out=self.prefix)

    def edges(self, width: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last prefix of every vector's window on every projection."""
        low, high = np.empty(self.order.shape, np.int32), np.empty(self.order.shape, np.int32)
        for k, (order, values) in enumerate(zip(self.order, self.sorted)):
            low[k, order] = np.searchsorted(values, values - width, "left") // STEP
            high[k, order] = -(-np.searchsorted(values, values + width, "right") // STEP)
        return low, high

    def collide(self, queries: np.ndarray, edges, word: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(position in queries, vector) of all that lie in enough of the queries' windows; vectors from 64 * ``word`` on."""
        planes: list = []
        low, high = edges
        for k, part in enumerate(self.prefix[:, :, word:]):
            _add(planes, part[high[k, queries]] ^ part[low[k, queries]])
        hit = _at_least(planes, self.needed).ravel()
        at = np.flatnonzero(hit)
        row, bit = np.nonzero(np.unpackbits(hit[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        size = self.words - word
        return at[row] // size, (at[row] % size + word) * 64 + bit


def _k_first(i, j, c, ids, k):
    """The k best of each i: by cosine, then the smaller id."""
    order = np.lexsort((ids[j], -c, i))
    i, j, c = i[order], j[order], c[order]
    start = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
    return i[rank < k], j[rank < k], c[rank < k]


def near_pairs(ids: np.ndarray, unit: np.ndarray, block: np.ndarray | None, cosine: float, k: int, tile: int = 256):
    """Directed (i, j, cosine): the k best of every vector among those of at least ``cosine`` in one array; with blocks only across them."""
    n = len(ids)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    if n < 2:
        return none
    # Start where a query's window holds few dozen vectors as near as wanted.
    sample = unit[:: max(1, n // 16)] @ unit.T
    steps = [cosine] + [1 - (1 - cosine) * f for f in (0.5, 0.25, 0.1, 0.03, 0.01, 0.001) if (1 - cosine) * f > 1e-6]
    first = next((s for s, c in enumerate(steps) if (sample >= c).sum() <= 96 * len(sample)), len(steps) - 1)
    windows, left, found = Windows(unit), np.arange(n), [none]
    for s in range(first, -1, -1):
        edges = windows.edges(np.float32(SPREAD * np.sqrt(2 - 2 * steps[s]) / np.sqrt(unit.shape[1]) + 1e-5))
        # Where all vectors ask at the last step, each pair is counted once, by the earlier vector.
        half, short, kept = len(left) == n and s == 0, [], [none]
        for at in range(0, len(left), tile):
            queries = left[at : at + tile]
            q, j = windows.collide(queries, edges, at >> 6 if half else 0)
            i = queries[q]
            other = ids[i] != ids[j]
            if half:
                other &= j > i
            if block is not None:
                other &= block[i] != block[j]
            i, j = i[other], j[other]
            c = np.concatenate([np.einsum("ij,ij->i", unit[i[b : b + 65536]], unit[j[b : b + 65536]]) for b in range(0, len(i), 65536)]) if len(i) else none[2]
            fine = c >= steps[s]
            i, j, c = i[fine], j[fine], c[fine]
            if s:
                enough = np.bincount(i, minlength=n)[queries] >= k
                short.append(queries[~enough])
                done = np.zeros(n, bool)
                done[queries[enough]] = True
                i, j, c = i[done[i]], j[done[i]], c[done[i]]
            kept.append((i, j, c))
        i, j, c = (np.concatenate(x) for x in zip(*kept))
        found.append(_k_first(*((np.append(i, j), np.append(j, i), np.append(c, c)) if half else (i, j, c)), ids, k))
        left = np.concatenate(short) if short else left[:0]
    return tuple(np.concatenate(x) for x in zip(*found))


def _raw_codes(x: np.ndarray) -> np.ndarray:
    """Bytes of unit vectors in 16-bit fixed point, after their scale."""
    scale = np.abs(x).max(axis=1) if len(x) else np.zeros(0)
    return np.concatenate([scale.astype(np.float32).view(np.uint8).reshape(-1, 4), np.rint(x / scale[:, None] * 32767).astype(np.int16).view(np.uint8).reshape(len(x), -1)], axis=1)


def _codes(x: np.ndarray):
    """Arrow column of the same."""
    import pyarrow as pa

    return pa.array([c.tobytes() for c in _raw_codes(x)], pa.binary())


def _decoded(table, dim: int):
    """Rows kept of an Arrow table of codes, and their ids in ascending order, unit vectors and blocks.

    Rows delivered again are dropped here, where all of them meet.
    """
    raw = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, 4 + 2 * dim)
    unit = raw[:, 4:].copy().view(np.int16).astype(np.float32) * (raw[:, :4].copy().view(np.float32) / 32767)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    ids = table.column("vec_id").to_numpy()
    block = table.column("block").to_numpy()
    order = np.argsort(ids, kind="stable")
    again = np.isin(ids, np.unique(ids[order[1:]][ids[order[1:]] == ids[order[:-1]]]))
    if again.any():
        rows = np.flatnonzero(again)
        _, first = np.unique(np.concatenate([ids[rows, None].view(np.uint8).reshape(len(rows), -1), raw[rows]], axis=1), axis=0, return_index=True)
        again[rows[first]] = False
        order = order[~again[order]]
    return order, ids[order], unit[order], block[order]


def k_best(ids_a, xa, ids_b, xb, k: int):
    """(a, b, cosine) of the k best of another id in block b for every id of block a, whatever their cosine.

    Ids ascend in both, so a later vector of the same cosine has no claim.
    """
    _, counts = np.unique(ids_b, return_counts=True)
    keep = (k + 1) * int(counts.max()) if len(counts) else 0  # room for the id itself and for ids of several vectors
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(xa), TILE):
        x = xa[at : at + TILE]
        least = np.full(len(x), -np.inf, np.float32)
        i, j, c = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        left = 0
        while left < len(xb):
            s = x @ xb[left : left + (8 * TILE if left else max(TILE, keep))].T
            if not left and s.shape[1] > keep:
                # The first columns give each row a bound; ties with it stay.
                least = np.nextafter(np.partition(s, s.shape[1] - keep, axis=1)[:, -keep], np.float32(-2))
            more = np.flatnonzero(s > least[:, None])
            if len(more):
                i, j, c = np.concatenate([i, more // s.shape[1]]), np.concatenate([j, more % s.shape[1] + left]), np.concatenate([c, s.ravel()[more]])
                order = np.lexsort((j, -c, i))
                i, j, c = i[order], j[order], c[order]
                start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
                last = rank == keep - 1
                least[i[last]] = c[last]
                i, j, c = i[rank < keep], j[rank < keep], c[rank < keep]
            left += s.shape[1]
        a, b = ids_a[i + at], ids_b[j]
        other = a != b
        out.append((a[other], b[other], c[other].astype(np.float64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def neighbours(vectors: DataFrame, *, k: int = K_BEST, dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """vec_id, neighbour_id, cosine, rank (1..k): the k most similar of every vector, however low their cosine.

    Every pair of blocks of ``block`` vectors is multiplied in one task, so no
    vector is short of k (unless there are fewer others) and none is missed.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).select(F.col("vec_id").cast("bigint"), F.col("vector").cast("array<float>"))
    blocks = max(1, math.ceil(rows.count() / block))

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            at, x = _unit(batch.column("vector"), dim)
            if not len(at):
                continue
            ids, codes = batch.column("vec_id").to_numpy(zero_copy_only=False)[at], _codes(x)
            mine = ((ids * 0x9E3779B1 >> 7) % blocks).astype(np.int32)
            for other in range(blocks):
                yield pa.RecordBatch.from_pydict({"x": pa.array(np.minimum(mine, other).astype(np.int32)), "y": pa.array(np.maximum(mine, other).astype(np.int32)), "block": pa.array(mine), "vec_id": pa.array(ids), "code": codes})

    def verify(key, table):
        import pyarrow as pa

        x_, y_ = key[0].as_py(), key[1].as_py()
        _, ids, unit, own = _decoded(table, dim)
        one, two = own == x_, own == y_
        found = [k_best(ids[one], unit[one], ids[two], unit[two], k)]
        if x_ != y_:
            found.append(k_best(ids[two], unit[two], ids[one], unit[one], k))
        a, b, c = (np.concatenate(x) for x in zip(*found))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64())})

    pairs = rows.mapInArrow(emit, "x int, y int, block int, vec_id bigint, code binary").groupBy("x", "y").applyInArrow(verify, _PAIRS)
    return _ranked(pairs.repartition("a"), k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    best = pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("rank") <= k)
    return ranked.select(F.col("a").alias("vec_id"), F.col("b").alias("neighbour_id"), "cosine", "rank")


def near(vectors: DataFrame, *, k: int = K_BEST, cosine: float = MIN_COSINE, dim: int = DIM, seed: int = 7, array: int = ARRAY, large: int = LARGE, hot: int = HOT_COPIES) -> DataFrame:
    """vec_id, neighbour_id, cosine, rank (1..k) among the neighbours of at least ``cosine``; a vector without such has no row."""
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).select(F.col("vec_id").cast("bigint"), F.col("vector").cast("array<float>"))

    def units(batches):
        for batch in batches:
            at, x = _unit(batch.column("vector"), dim)
            if len(at):
                yield batch.column("vec_id").to_numpy(zero_copy_only=False)[at], x

    def sums(batches):
        import pyarrow as pa

        n, total = 0, np.zeros(dim)
        for _, x in units(batches):
            n, total = n + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "total": pa.array([total.tolist()])})

    parts = rows.mapInArrow(sums, "n bigint, total array<double>").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim)]).first()
    count = parts["n"] or 0
    centre = np.array([parts[f"t{i}"] or 0.0 for i in range(dim)]) / max(1, count)
    m = plan(count, dim, array)

    def marked(x):
        y = x - centre
        y /= np.maximum(np.sqrt((y * y).sum(axis=1)), 1e-12)[:, None]
        return arrays_of(y, [projections(seed, t, dim, m) for t in range(TABLES)])

    def census(batches):
        import pyarrow as pa

        sizes = np.zeros(TABLES * 4 * m * m, np.int64)
        for ids, x in units(batches):
            sizes += np.bincount(marked(x).ravel(), minlength=len(sizes))
            same, n = np.unique(_direction(_raw_codes(x)), return_counts=True)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(len(same), np.int32)), "value": pa.array(same), "n": pa.array(n.astype(np.int64))})
        used = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(len(used), np.int32)), "value": pa.array(used.astype(np.int64)), "n": pa.array(sizes[used])})

    counted = rows.mapInArrow(census, "kind int, value bigint, n bigint").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    # An entry an array and a hot direction at most: both bounded whatever the data.
    notable = counted.where(((F.col("kind") == 1) & (F.col("n") > large)) | ((F.col("kind") == 0) & (F.col("n") > max(hot, count // HOT_SHARE)))).collect()
    blocks = np.ones(TABLES * 4 * m * m, np.int64)
    for r in notable:
        if r["kind"]:
            blocks[r["value"]] = -(-2 * r["n"] // large)
    crowd = np.sort(np.array([r["value"] for r in notable if not r["kind"]], np.int64))
    head = _smallest(rows, units, crowd, k + 1)

    def travels(ids, x):
        """Rows that enter arrays: all but those of a hot direction behind its k + 1 smallest ids."""
        code = _raw_codes(x)
        if not len(crowd):
            return code, np.ones(len(ids), bool)
        way = _direction(code)
        return code, ~np.isin(way, crowd) | np.fromiter((i in head.get(w, ()) for i, w in zip(ids.tolist(), way.tolist())), bool, len(ids))

    def emit(batches):
        import pyarrow as pa

        for ids, x in units(batches):
            code, go = travels(ids, x)
            ids, x, code = ids[go], x[go], code[go]
            names, codes = marked(x), pa.array([c.tobytes() for c in code], pa.binary())
            for t in range(names.shape[1]):
                parts_ = blocks[names[:, t]]
                own = np.repeat(np.arange(len(ids)), parts_)
                mine = ((ids * 0x9E3779B1 >> 7) % parts_)[own].astype(np.int32)
                other = (np.arange(len(own)) - np.repeat(np.cumsum(parts_) - parts_, parts_)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"array": pa.array(names[own, t]), "x": pa.array(np.minimum(mine, other)), "y": pa.array(np.maximum(mine, other)), "block": pa.array(mine), "vec_id": pa.array(ids[own]), "code": codes.take(pa.array(own))})

    def verify(key, table):
        import pyarrow as pa

        own, x_, y_ = (key[c].as_py() for c in range(3))
        _, ids, unit, block = _decoded(table, dim)
        i, j, c = near_pairs(ids, unit, None if x_ == y_ else block, cosine - 2e-5, k)
        if len(i):
            names = marked(unit.astype(np.float64))
            shared = (names[i][:, :, None] == names[j][:, None, :]).any(axis=2)
            first = np.where(shared, names[i], np.iinfo(np.int32).max).min(axis=1) == own
            # Fixed point may put a mark elsewhere; a pair that seems to share nothing is reported where it met.
            first |= ~shared.any(axis=1)
            i, j, c = i[first], j[first], c[first]
        return pa.table({"a": pa.array(ids[i], pa.int64()), "b": pa.array(ids[j], pa.int64()), "cosine": pa.array(c.astype(np.float64), pa.float64())})

    def followers(batches):
        import pyarrow as pa

        for ids, x in units(batches):
            code, go = travels(ids, x)
            lists = [head[w][:k] for w in _direction(code[~go]).tolist()]
            own = np.repeat(ids[~go], [len(b) for b in lists])
            yield pa.RecordBatch.from_pydict({"a": pa.array(own, pa.int64()), "b": pa.array([b for each in lists for b in each], pa.int64()), "cosine": pa.array(np.ones(len(own)))})

    # The work lies in the comparisons, not in the bytes, so the number of tasks is set from the rows.
    tasks = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-9 * count // 50_000))
    pairs = rows.mapInArrow(emit, _CODES).repartition(tasks, "array", "x", "y").groupBy("array", "x", "y").applyInArrow(verify, _PAIRS).where(F.col("cosine") >= cosine)
    if len(crowd):
        pairs = pairs.unionAll(rows.mapInArrow(followers, _PAIRS))
    return _ranked(pairs, k)


def _direction(code: np.ndarray) -> np.ndarray:
    """64-bit hash of the elements of a code (not its scale)."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(c) for c in np.ascontiguousarray(code[:, 4:])), np.uint64, len(code)).view(np.int64)


def _smallest(rows: DataFrame, units, crowd: np.ndarray, k: int) -> dict[int, list[int]]:
    """The k smallest ids of every hot direction; a task sends k a direction."""
    if not len(crowd):
        return {}

    def heads(batches):
        import pyarrow as pa

        kept: dict[int, list[int]] = {}
        for ids, x in units(batches):
            way = _direction(_raw_codes(x))
            hit = np.isin(way, crowd)
            for w in np.unique(way[hit]).tolist():
                kept[w] = sorted({*kept.get(w, []), *ids[way == w].tolist()})[:k]
        flat = [(w, i) for w, ids in kept.items() for i in ids]
        yield pa.RecordBatch.from_pydict({"way": pa.array([w for w, _ in flat], pa.int64()), "id": pa.array([i for _, i in flat], pa.int64())})

    sent = rows.mapInArrow(heads, "way bigint, id bigint").distinct()
    ranked = sent.withColumn("r", F.row_number().over(Window.partitionBy("way").orderBy("id"))).where(F.col("r") <= k)
    out: dict[int, list[int]] = {}
    for r in sorted(ranked.collect(), key=lambda r: r["id"]):
        out.setdefault(r["way"], []).append(r["id"])
    return out


def similar_pairs(vectors: DataFrame, **options) -> DataFrame:
    """vec_id_a < vec_id_b of pairs in which one is among the k most similar of the other."""
    found = near(vectors, **options)
    return found.select(F.least("vec_id", "neighbour_id").alias("vec_id_a"), F.greatest("vec_id", "neighbour_id").alias("vec_id_b")).distinct()


def search(vectors: DataFrame, *, k: int = K_BEST, every: int = 100, dim: int = DIM, block: int = 65_536) -> DataFrame:
    """vec_id, neighbour_id, cosine, rank: the k most similar of all vectors, exactly, for the ids divisible by ``every``.

    The queries go over the scan in blocks of ``block`` vectors (16 MB); each
    task keeps k candidates a query.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).select(F.col("vec_id").cast("bigint"), F.col("vector").cast("array<float>"))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    blocks = max(1, math.ceil(asked.count() / block))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found = None
    for part in range(blocks):
        table = asked.where(F.col("part") == part).select("vec_id", "vector").toArrow()
        if not table.num_rows:
            continue
        at, x = _unit(table.column("vector").combine_chunks(), dim)
        queries = spark.sparkContext.broadcast((table.column("vec_id").to_numpy()[at], x.astype(np.float32)))

        def scan(batches, queries=queries):
            import pyarrow as pa

            qid, q = queries.value
            best_c, best_i = np.full((len(qid), k), -np.inf), np.full((len(qid), k), np.iinfo(np.int64).max)
            for batch in batches:
                where, x = _unit(batch.column("vector"), dim)
                ids, first = np.unique(batch.column("vec_id").to_numpy(zero_copy_only=False)[where], return_index=True)
                x = x[first].astype(np.float32)
                for at in range(0, len(qid), TILE):
                    s = (q[at : at + TILE] @ x.T).astype(np.float64)
                    s[qid[at : at + TILE, None] == ids[None, :]] = -np.inf
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(s), 1))
                    c = np.concatenate([best_c[at : at + TILE], np.take_along_axis(s, top, axis=1)], axis=1)
                    i = np.concatenate([best_i[at : at + TILE], ids[top]], axis=1)
                    again = (i[:, k:, None] == i[:, None, :k]).any(axis=2)  # a row delivered again in another batch
                    c[:, k:][again] = -np.inf
                    order = np.lexsort((i, -c), axis=1)[:, :k]
                    best_c[at : at + TILE], best_i[at : at + TILE] = np.take_along_axis(c, order, axis=1), np.take_along_axis(i, order, axis=1)
            real = np.isfinite(best_c)
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.repeat(qid, k).reshape(-1, k)[real]), "b": pa.array(best_i[real]), "cosine": pa.array(best_c[real])})

        part_found = rows.mapInArrow(scan, _PAIRS)
        found = part_found if found is None else found.unionAll(part_found)
    if found is None:
        found = spark.createDataFrame([], _PAIRS)
    best = found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("rank") <= k)
    return ranked.select(F.col("a").alias("vec_id"), F.col("b").alias("neighbour_id"), F.round("cosine", 5).alias("cosine"), "rank")
