"""Lossless similarity join of word sets by signatures of their parts.

Two sets of sizes a and b with likeness (shared / all words) of at least t
differ in at most D = floor((1 - t) / (1 + t) * (a + b)) words.  Words are ordered
by their hash, and the range of hashes is cut at fixed borders.  The words between
two borders, a run of consecutive words, are a gram; a word that differs changes
the one gram it falls into.  Two kinds of parts are made of a set:

* ``variants`` wide segments, each indexed by its words and, once a word, by its
  words less that one (deletion variants).  They are found unless two sets differ
  in two words of each.
* grams of the rest.  Of these each set keeps K = D + 1 - 2 * variants, the rarest
  by the words in them.  If fewer than K of all grams are changed, the rarest K of
  both sets have one in common, since both sets rank them alike.

To miss a pair, 2 * variants words would have to differ in the segments and K in
the grams, D + 1 in all.  So no pair is lost.

D depends on a + b; the sums are cut in levels that grow by a factor, and a set
is signed for each level that a partner may put it in.

Exchange.  Signatures without a partner are not known in advance, at any size of
the data, and no filter is kept: a signature costs 18 bytes.  A task packs those
of a batch into one block a part of the signature space: sorted 40-bit signatures
as differences, 40-bit class, parity, size.  Parts are sized from the number of
sets, so a part fits a task.

Comparison.  Each signature carries the parity of its set's words in 64 buckets.
A word that differs flips one bit, so more than D different bits rule a pair out
without the words.  Equal sets form a class and only classes are compared; members
are added at the end.  A bucket of more than ``HOT`` classes is not compared: its
sets are signed again, with the words dealt anew and the bucket's signature in the
new ones, until no bucket is larger (after ``ROUNDS`` what is left is joined by
Spark, which splits a large key over tasks).  The argument above holds for any way
of dealing, so no pair is lost there either.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.plans.staging import stage

SETS = "cls bigint, chk bigint, role int, salt bigint, words array<bigint>"
BLOCKS = "part int, payload binary"
FOUND = "kind int, a bigint, b bigint"  # 0: a pair; 1 + role: a class and the signature of a large bucket it is in
_SEEN = 1 << 18
HOT, ROUNDS, PART_BYTES, ENTRY_BYTES = 16_384, 4, 24_000_000, 18
WIDEST = (1 << 13) - 1  # sizes from here on are not told apart
ID_BITS = 40
RARITY = 1 << 18  # counters of word frequencies; words that share one rank alike
SPARE = 1.25  # grams made for each gram kept


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (the finaliser of splitmix64; fixed constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ladder(top: int, step: float) -> np.ndarray:
    """Upper ends of the levels of a + b, up to ``top``."""
    ends = [1]
    while ends[-1] < top:
        ends.append(max(ends[-1] + 1, int(ends[-1] * step)))
    return np.array(ends, np.int64)


def levels(sizes: np.ndarray, num: int, den: int, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of all levels, and the lowest and highest level of each size with a partner of any likely size."""
    sizes = sizes.astype(np.int64)
    least, most = sizes + -(-num * sizes // den), sizes + den * sizes // num
    ends = ladder(int(most.max(initial=1)), step)
    return ends, np.searchsorted(ends, least), np.searchsorted(ends, most)


def signatures(flat: np.ndarray, offsets: np.ndarray, num: int, den: int, *, variants: int = 0, step: float = 1.25, rarity: np.ndarray | None = None, deal: int = 0):
    """(hash, index of the set, is a deletion variant) of all signatures of a block of sets; ``deal`` picks the order of the words."""
    sizes = np.diff(offsets)
    ends, low, high = levels(sizes, num, den, step)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rare = np.zeros(len(flat), np.int64) if rarity is None else rarity[(flat & np.uint64(RARITY - 1)).astype(np.int64)].astype(np.int64)
    out = []
    for level in range(int(low.min(initial=1 << 30)), int(high.max(initial=-1)) + 1):
        part = (low <= level) & (level <= high) & (sizes > 0)
        if not part.any():
            continue
        differ = int(ends[level]) * (den - num) // (den + num)
        wide = min(variants, (differ + 1) // 2)
        kept = differ + 1 - 2 * wide
        grams = max(kept, round(kept * SPARE))
        share = 0.0 if not wide else 1.0 if not kept else max(0.15, 1.5 / (kept + 1.5))
        chosen = part[owner]
        count, local = int(part.sum()), np.cumsum(part) - 1
        row, all_ = local[owner[chosen]], wide + grams
        g = mix(flat[chosen] + np.uint64((level + 1 + 256 * deal) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        place = (g >> np.uint64(11)).astype(np.float64) / (1 << 53)
        cut = np.where(place < share, place / (share or 1.0) * wide, wide + (place - share) / (1 - share or 1.0) * grams)
        cut = np.minimum(cut.astype(np.int64), all_ - 1)
        key = row * all_ + cut
        total = np.zeros(count * all_, np.uint64)
        np.add.at(total, key, g)
        tag = mix(np.arange(all_, dtype=np.uint64) + np.uint64((level + 1) << 40))
        whole = mix(total ^ np.tile(tag, count)).reshape(count, all_)
        ids = np.flatnonzero(part)
        if kept:
            weight = np.bincount(key, weights=rare[chosen], minlength=count * all_).astype(np.int64).reshape(count, all_)[:, wide:]
            # Rarest first; ties by hash, then by place, so every set ranks a gram alike.
            rank = np.argsort((whole[:, wide:] >> np.uint64(33)).astype(np.int64) - (np.minimum(weight, (1 << 30) - 1) << 32), axis=1, kind="stable")[:, :kept]
            out.append((np.take_along_axis(whole[:, wide:], rank, axis=1).ravel(), np.repeat(ids, kept), np.zeros(count * kept, bool)))
        if wide:
            out.append((whole[:, :wide].ravel(), np.repeat(ids, wide), np.zeros(count * wide, bool)))
            inside = cut < wide
            out.append((mix((total[key[inside]] - g[inside]) ^ tag[cut[inside]]), ids[row[inside]], np.ones(int(inside.sum()), bool)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def parities(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity of the number of words in each of 64 buckets, as one 64-bit word a set."""
    bit = np.uint64(1) << (mix(flat ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(58))
    value = np.bitwise_xor.reduceat(np.append(bit, np.uint64(0)), offsets[:-1])
    return np.where(np.diff(offsets) > 0, value, np.uint64(0))


def _blocks(batches):
    """Sets of each batch, each class, role and salt once; one seen a short time ago is passed over.

    The memory is a fixed table of recent classes, so a class may be sent again;
    that costs rows and changes nothing.
    """
    recent = np.zeros(_SEEN, np.uint64)
    for batch in batches:
        cls = batch.column("cls").to_numpy(zero_copy_only=False).view(np.uint64)
        role = batch.column("role").to_numpy(zero_copy_only=False).astype(np.uint64)
        salt = batch.column("salt").to_numpy(zero_copy_only=False).view(np.uint64)
        key = mix(mix(cls ^ (role + np.uint64(1))) + salt) ^ batch.column("chk").to_numpy(zero_copy_only=False).view(np.uint64)
        key[key == 0] = 1
        slot = (key & np.uint64(_SEEN - 1)).astype(np.int64)
        _, first = np.unique(key, return_index=True)
        first = np.sort(first[recent[slot[first]] != key[first]])
        recent[slot[first]] = key[first]
        if not len(first):
            continue
        import pyarrow as pa

        block = batch.take(pa.array(first))
        words = block.column("words")
        flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = np.asarray(words.value_lengths().fill_null(0)).astype(np.int64)
        yield block, flat, np.concatenate([[0], np.cumsum(sizes)])


def packed(sig: np.ndarray, cls: np.ndarray, parity: np.ndarray, size: np.ndarray, flags: np.ndarray, parts: int):
    """(part, bytes) of the entries of one batch; signatures and classes are cut to 40 bits, sizes to 13."""
    order = np.argsort(sig)
    sig, cls, parity = sig[order], cls[order] >> np.uint64(64 - ID_BITS), parity[order]
    size = (np.minimum(size, WIDEST) * 8 + flags).astype(np.uint16)[order]
    part = ((sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    short = sig >> np.uint64(24)
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    for start, stop in zip(at, np.append(at[1:], len(part))):
        s = short[start:stop]
        steps = np.diff(s, prepend=s[:1])
        width = max(1, (int(steps.max()).bit_length() + 7) // 8)
        plane = lambda x, n: np.ascontiguousarray(x[start:stop]).view(np.uint8).reshape(stop - start, -1)[:, :n].tobytes()
        head = np.array([s[0], stop - start, width], np.uint64).tobytes()
        yield int(part[start]), head + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + plane(cls, ID_BITS // 8) + plane(parity, 8) + plane(size, 2)


def unpacked(payloads: list[bytes]):
    """Signature, class, parity, size and flags of all entries."""
    out = []
    for data in payloads:
        first, n, width = (int(v) for v in np.frombuffer(data, np.uint64, 3))
        raw, at = np.frombuffer(data, np.uint8, offset=24), 0

        def column(bytes_, kind):
            nonlocal at
            piece, size = raw[at : at + n * bytes_].reshape(n, bytes_), np.dtype(kind).itemsize
            at += n * bytes_
            wide = np.zeros((n, size), np.uint8)
            wide[:, :bytes_] = piece
            return wide.view(kind).ravel()

        out.append((np.cumsum(column(width, np.uint64)) + np.uint64(first), column(ID_BITS // 8, np.uint64), column(8, np.uint64), column(2, np.uint16)))
    sig, cls, parity, size = (np.concatenate(x) for x in zip(*out))
    return sig, cls, parity, size >> 3, (size & 7).astype(np.uint8)


def compare(sig, cls, parity, size, flags, num: int, den: int, *, between_roles: bool, hot: int):
    """(pairs of classes that may be alike, entries of buckets of more than ``hot``) of one part.

    ``flags``: role * 2 + deletion variant.  Entries at a distance of 1, 2, ...
    within their bucket are compared all at once, larger buckets first, so each
    distance is one pass over a prefix.
    """
    order = np.lexsort((flags, cls, sig))
    sig, cls, parity, size, flags = sig[order], cls[order], parity[order], size[order].astype(np.int32), flags[order]
    fresh = np.append(True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1]) | (flags[1:] != flags[:-1]))
    sig, cls, parity, size, flags = sig[fresh], cls[fresh], parity[fresh], size[fresh], flags[fresh]
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    n = np.diff(np.append(start, len(sig)))
    bucket = np.repeat(np.arange(len(n)), n)
    # A bucket needs an entry that is no variant, or both roles.
    own = np.bincount(bucket, weights=(flags >> 1 == 1) if between_roles else (flags & 1 == 0), minlength=len(n))
    open_ = (n > 1) & ((own > 0) & (own < n) if between_roles else own > 0)
    large = open_ & (n > hot)
    over = large[bucket]
    left = np.argsort(-n[bucket], kind="stable")
    left = left[(open_ & ~large)[bucket[left]]]
    b, p, z = bucket[left].astype(np.int32), parity[left], size[left]
    longest = int(n[b[0]]) if len(b) else 1
    # How many entries are in buckets of more than d.
    upto = np.searchsorted(-n[b], -np.arange(1, longest), side="left")
    hits = []
    for d in range(1, longest):
        end = int(upto[d - 1])
        x, y = slice(0, end - d), slice(d, end)
        near = np.bitwise_count(p[x] ^ p[y]).astype(np.int32) * (den + num) <= (z[x] + z[y]) * (den - num)
        i = np.flatnonzero(near & (b[x] == b[y]))
        if len(i):
            hits.append(np.stack([left[i], left[i + d]]))
    i, j = np.concatenate(hits, axis=1) if hits else np.zeros((2, 0), np.int64)
    # A size at the limit of its field says nothing but that it is large.
    open_size = np.maximum(size[i], size[j]) == WIDEST
    fine = (cls[i] != cls[j]) & (open_size | (np.minimum(size[i], size[j]) * den >= np.maximum(size[i], size[j]) * num))
    fine &= (flags[i] >> 1 != flags[j] >> 1) if between_roles else (flags[i] & flags[j] & 1 == 0)
    i, j = i[fine], j[fine]
    swap = (flags[i] >> 1 != 1) if between_roles else cls[i] > cls[j]
    pairs = np.unique(np.stack([np.where(swap, cls[j], cls[i]), np.where(swap, cls[i], cls[j])]), axis=1)
    return pairs.astype(np.int64), (cls[over].astype(np.int64), (sig[over] << np.uint64(24)).view(np.int64), (flags[over] >> 1).astype(np.int32))


def build_sets(rows: DataFrame, words, label: str, keep: list[str]) -> DataFrame:
    """Stage one row a delivered record: kept columns, word hashes, and the class of the set.

    The staged words take little room, since Parquet stores each word of a
    row group once.  Records without any word take no part.
    """
    sets = rows.select(*keep, words.alias("words")).where(F.size("words") > 0)
    sets = sets.withColumn("cls", F.xxhash64("words")).withColumn("chk", F.xxhash64(F.lit(7), "words"))
    return stage(sets, label)


def word_rarity(scan: DataFrame) -> np.ndarray:
    """16 times the negative logarithm of each counter's share of the words: ``RARITY`` numbers, whatever the data."""

    def count(batches):
        import pyarrow as pa

        n = np.zeros(RARITY, np.int64)
        for batch in batches:
            n += np.bincount(batch.column("words").flatten().to_numpy(zero_copy_only=False).view(np.uint64).astype(np.int64) & (RARITY - 1), minlength=RARITY)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(used.astype(np.int32)), "n": pa.array(n[used])})

    counts = scan.select("words").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(RARITY, np.int64)
    total[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    return np.rint(16 * np.log(max(1, total.sum()) / np.maximum(total, 1))).astype(np.int16)


def class_pairs(sets: DataFrame, num: int, den: int, *, between_roles: bool = False, variants: int = 0, step: float = 1.25, label: str = "join", hot: int = HOT) -> DataFrame:
    """Pairs of different classes with likeness of at least num / den.

    ``sets`` has cls, chk, role, words.  With ``between_roles`` only pairs of a
    role-1 and a role-2 class are searched.  Returns cls_a, chk_a, cls_b, chk_b,
    shared, total; each pair once with cls_a < cls_b (or, between roles, with
    the role-1 class first).
    """
    spark = sets.sparkSession
    scan = sets.select("cls", "chk", "role", F.lit(0).cast("bigint").alias("salt"), "words")
    rarity = spark.sparkContext.broadcast(word_rarity(scan))
    rows, found = scan, None
    for deal in range(ROUNDS):
        per_set = 40  # entries: about 20 to 30, more for long texts
        parts = max(2 * spark.sparkContext.defaultParallelism, -(-rows.count() * per_set * ENTRY_BYTES // PART_BYTES))

        def emit(batches, deal=deal, parts=parts):
            import pyarrow as pa

            for block, flat, offsets in _blocks(batches):
                sig, owner, gap = signatures(flat, offsets, num, den, variants=variants, step=step, rarity=rarity.value, deal=deal)
                salt = block.column("salt").to_numpy(zero_copy_only=False).view(np.uint64)
                if deal:
                    sig = mix(sig ^ salt[owner] * np.uint64(0xC2B2AE3D27D4EB4F))
                flags = (block.column("role").to_numpy(zero_copy_only=False)[owner] * 2 + gap).astype(np.uint8)
                cls = block.column("cls").to_numpy(zero_copy_only=False).view(np.uint64)
                sent = list(packed(sig, cls[owner], parities(flat, offsets)[owner], np.diff(offsets)[owner], flags, parts))
                yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in sent], pa.int32()), "payload": pa.array([d for _, d in sent], pa.binary())})

        def match(table):
            import pyarrow as pa

            pairs, (cls, sig, role) = compare(*unpacked(table.column("payload").to_pylist()), num, den, between_roles=between_roles, hot=hot)
            kind = np.concatenate([np.zeros(pairs.shape[1], np.int32), 1 + role])
            return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(np.concatenate([pairs[0], cls])), "b": pa.array(np.concatenate([pairs[1], sig]))})

        out = stage(rows.mapInArrow(emit, BLOCKS).repartition(parts, "part").groupBy("part").applyInArrow(match, FOUND), f"{label}-found{deal}")
        mine = out.where("kind = 0").select("a", "b")
        found = mine if found is None else found.unionAll(mine)
        large = out.where("kind > 0").select(F.col("a").alias("id"), F.col("b").alias("salt"), (F.col("kind") - 1).alias("role"))
        if not large.limit(1).count():
            break
        if deal == ROUNDS - 1:
            x, y = large.select("id", "salt", "role").toDF("a", "salt", "role_a"), large.toDF("b", "salt", "role_b")
            rest = x.join(y, "salt").where((F.col("role_a") == 1) & (F.col("role_b") == 2) if between_roles else F.col("a") < F.col("b"))
            found = found.unionAll(rest.select("a", "b"))
            break
        some = picked(scan, large.select("id"), large.count()).drop("role")
        rows = stage(large.join(some, "id").select("cls", "chk", "role", "salt", "words"), f"{label}-large{deal}")
    return verify(scan, stage(found.distinct(), f"{label}-candidates"), num, den)


def picked(scan: DataFrame, named: DataFrame, count: int) -> DataFrame:
    """id (40 bits of the class), cls, chk, role, words of the classes named, each once.

    Only sets that are named leave their scan, by a fixed-size filter; where it is
    full more of them do, and the joins behind drop them.
    """
    wanted = scan.sparkSession.sparkContext.broadcast(bitmap.of_column(named, "id", count))

    def pick(batches):
        import pyarrow as pa

        for block, _, _ in _blocks(batches):
            hit = bitmap.has(wanted.value, block.column("cls").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - ID_BITS))
            if hit.any():
                yield block.filter(pa.array(hit))

    some = scan.mapInArrow(pick, SETS).select(F.shiftrightunsigned("cls", 64 - ID_BITS).alias("id"), "cls", "chk", "role", "words")
    # One exchange by id serves the removal of repeats and the joins.
    return some.repartition("id").dropDuplicates(["id", "cls", "chk"])


def verify(scan: DataFrame, candidates: DataFrame, num: int, den: int) -> DataFrame:
    """Exact likeness of candidate class pairs (a, b) from the words themselves."""
    some = picked(scan, candidates.select(F.explode(F.array("a", "b")).alias("id")), 2 * candidates.count())
    left = some.select(F.col("id").alias("a"), F.col("cls").alias("cls_a"), F.col("chk").alias("chk_a"), F.col("words").alias("words_a"))
    right = some.select(F.col("id").alias("b"), F.col("cls").alias("cls_b"), F.col("chk").alias("chk_b"), F.col("words").alias("words_b"))
    both = candidates.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    scored = both.select("cls_a", "chk_a", "cls_b", "chk_b", shared.alias("shared"), (F.size("words_a") + F.size("words_b")).alias("both"))
    return scored.where(F.col("shared") * (den + num) >= F.col("both") * num).select("cls_a", "chk_a", "cls_b", "chk_b", "shared", (F.col("both") - F.col("shared")).alias("total"))
