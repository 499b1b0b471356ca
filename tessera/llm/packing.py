"""Problem 9: filling fixed-capacity containers with items.

Mixture-controlled packing.  Items are dealt to blocks by hash, so a source that
holds a third of all texts is spread over all blocks and a block stays within
``BLOCK`` containers.  In a block each source has a queue, and a container is a
window of a deficit round-robin: every source's deficit grows by its target share
of the capacity; sources take turns, beginning behind the one that began last, and
each gives its largest items that its deficit pays for and that fit.  What room is
left goes to the largest item that fits of the source with the largest deficit,
which then owes it.  Deficits are carried from container to container.  Containers
that a block leaves poorly filled are taken apart again; their items and the
deficits that are left go to the next round with far fewer blocks, which carries
both across partitions.

Target shares are given, or those of the corpus.  A source without a target has
share 0: its items fill what the others leave.  Texts run out, so the last windows
hold what is left; ``mixture_report`` measures the drift of consecutive windows.

A text above the capacity is cut in full containers and one item for the rest;
all others stay whole.  Null and empty texts have no tokens and no container.
A null source is a source of its own.  Rows without an id take no part; rows
repeated under one id are items of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import VOCABULARY, token_count
from tessera.plans.staging import stage

CAPACITY, BLOCK, FAN_IN, WELL_FILLED = 2048, 128, 64, 0.98
RUN = 32  # consecutive windows over which the mixture is measured
_OUT = "doc_id bigint, piece int, source string, share double, tokens int, slot int, deficit double"


def fill_block(items: list[tuple[int, str]], shares: dict, deficits: dict, capacity: int) -> list[list[int]]:
    """Containers as lists of item indices; ``deficits`` is updated in place."""
    from bisect import bisect_right, insort

    queues: dict = {}
    for i, (size, source) in enumerate(items):
        queues.setdefault(source, []).append((size, i))
    for queue in queues.values():
        queue.sort()
    containers: list[list[int]] = []
    ring, first = sorted(queues, key=str), 0

    def give(source, most: float) -> int:
        """Size of the largest item of a source up to ``most``, which is put into the window; 0 if there is none."""
        queue = queues.get(source)
        at = bisect_right(queue, (most, float("inf"))) - 1 if queue else -1
        if at < 0:
            return 0
        size, index = queue.pop(at)
        chosen.append(index)
        deficits[source] = deficits.get(source, 0.0) - size
        if not queue:
            del queues[source]
        return size

    while queues:
        room, chosen = capacity, []
        for source in shares:
            deficits[source] = deficits.get(source, 0.0) + shares[source] * capacity
        for k in range(len(ring)):
            source = ring[(first + k) % len(ring)]
            while room and (size := give(source, min(room, deficits.get(source, 0.0)))):
                room -= size
        first = (first + 1) % len(ring)
        # Sources by deficit; one that has nothing that fits is out for this window, as room only shrinks.
        order: list = sorted((deficits.get(s, 0.0), str(s), s) for s in queues) if room else []
        while order and room:
            _, _, source = order.pop()
            if size := give(source, room):
                room -= size
                if source in queues:
                    insort(order, (deficits[source], str(source), source))
        containers.append(chosen)
    return containers


def _round(items: DataFrame, debts: DataFrame | None, blocks: int, capacity: int, last: bool) -> DataFrame:
    """Pack every block; rows without slot are left over, rows without tokens carry a source's deficit."""
    rows = items.select("doc_id", "piece", "source", "share", "tokens", F.lit(None).cast("double").alias("deficit"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).alias("block"))
    if debts is not None:
        spread = debts.select("source", "share", "deficit", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        spread = spread.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("int").alias("piece"), "source", "share", F.lit(None).cast("int").alias("tokens"), (F.col("deficit") / blocks).alias("deficit"), F.col("block").cast("bigint"))
        rows = rows.unionAll(spread)

    def pack(key, pdf):
        import pandas as pd

        debt, real = pdf[pdf.tokens.isna()], pdf[pdf.tokens.notna()]
        real = real.sort_values(["doc_id", "piece"], kind="stable")
        deficits = debt.groupby("source", dropna=False).deficit.sum().to_dict()
        deficits = {(None if k != k else k): v for k, v in deficits.items()}
        sources = [None if s is None or s != s else s for s in real.source]
        items_ = list(zip((int(t) for t in real.tokens), sources))
        shares = {(None if s is None or s != s else s): v for s, v in zip(pdf.source, pdf.share)}
        slots: list = [None] * len(items_)
        k = 0
        for chosen in fill_block(items_, shares, deficits, capacity):
            if not last and sum(items_[i][0] for i in chosen) < WELL_FILLED * capacity:
                for i in chosen:
                    deficits[items_[i][1]] += items_[i][0]
                continue
            for i in chosen:
                slots[i] = k
            k += 1
        out = pd.DataFrame({"doc_id": real.doc_id.to_numpy(), "piece": real.piece.to_numpy(), "source": sources, "share": real.share.to_numpy(), "tokens": real.tokens.to_numpy(), "slot": slots, "deficit": None, "block": key[0]})
        carried = pd.DataFrame([(None, None, s, shares.get(s, 0.0), None, None, v, key[0]) for s, v in deficits.items()], columns=list(out.columns))
        kinds = {"doc_id": "Int64", "piece": "Int32", "share": "Float64", "tokens": "Int32", "slot": "Int32", "deficit": "Float64"}
        return out.astype(kinds) if last or carried.empty else pd.concat([out.astype(kinds), carried.astype(kinds)])

    return rows.groupBy("block").applyInPandas(pack, _OUT + ", block bigint")


def sized(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of every text with a token."""
    counted = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "source", token_count(F.col("text"), path).alias("n_tokens"))
    return counted.where("n_tokens > 0")


def target_shares(sizes: DataFrame, targets: DataFrame | None) -> DataFrame:
    """source, share of every source of the items: its target, or its share of the tokens; shares add up to 1 at most.

    ``targets`` has source (null for texts without one) and target_share; a source
    given twice has the larger one.
    """
    own = sizes.groupBy("source").agg(F.sum("n_tokens").alias("t"))
    if targets is None:
        total = sizes.agg(F.sum("n_tokens")).first()[0] or 1
        return own.select("source", (F.col("t") / total).alias("share"))
    wanted = targets.where(F.col("target_share") > 0).groupBy("source").agg(F.max("target_share").alias("w"))
    total = wanted.agg(F.sum("w")).first()[0] or 1.0
    wanted = wanted.select(F.col("source").alias("s"), (F.col("w") / total).alias("share"))
    return own.join(wanted, F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.coalesce("share", F.lit(0.0)).alias("share"))


def pack(docs: DataFrame, *, targets: DataFrame | None = None, capacity: int = CAPACITY, path: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """container_id, doc_id, piece, source, tokens, n_tokens (of the whole text), sequence, slot; one row a placed piece.

    Windows of one ``sequence`` were filled in the order of ``slot``; full pieces of
    texts above the capacity have neither.
    """
    sizes = stage(sized(docs, path), "p9-sizes")
    shares = target_shares(sizes, targets).withColumnRenamed("source", "of")
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    columns = ["container_id", "doc_id", "piece", "source", "tokens", "sequence", "slot"]
    cut = sizes.where(full > 0).select(F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), "doc_id", "source", F.lit(capacity).alias("tokens"))
    alone = cut.withColumn("container_id", F.concat_ws("-", F.lit("full"), "doc_id", "piece")).withColumn("sequence", F.lit(None).cast("string")).withColumn("slot", F.lit(None).cast("int")).select(columns)
    items = sizes.where(F.col("n_tokens") % capacity > 0).select("doc_id", full.alias("piece"), "source", (F.col("n_tokens") % capacity).cast("int").alias("tokens"))
    # A row a source: small beside the items, and broadcast by Spark only below its size threshold.
    items = items.join(shares, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    total = items.agg(F.sum("tokens")).first()[0] or 0
    blocks = max(1, -(-total // (capacity * block)))
    placed, debts, number = alone, None, 0
    while True:
        last = blocks == 1
        done = stage(_round(items, debts, blocks, capacity, last), f"p9-round{number}")
        packed = done.where("slot is not null").withColumn("sequence", F.concat_ws("-", F.lit(number), "block"))
        placed = placed.unionAll(packed.withColumn("container_id", F.concat_ws("-", "sequence", "slot")).select(columns))
        if last:
            break
        items = done.where("slot is null and tokens is not null")
        debts = done.where("tokens is null").groupBy("source").agg(F.max("share").alias("share"), F.sum("deficit").alias("deficit"))
        left = items.agg(F.sum("tokens")).first()[0] or 0
        blocks, number = max(1, min(-(-blocks // FAN_IN), -(-left // (capacity * block)))), number + 1
    return placed.join(sizes.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")), "doc_id").select("container_id", "doc_id", "piece", "source", "tokens", "n_tokens", "sequence", "slot")


def mixture_report(docs: DataFrame, *, targets: DataFrame | None = None, capacity: int = CAPACITY, path: str = VOCABULARY, run: int = RUN) -> DataFrame:
    """Per source: target_share, share of all packed tokens, and mean and largest drift from the target over runs of ``run`` consecutive windows.

    Only whole runs count; a source a run lacks has share 0 there.
    """
    placed = stage(pack(docs, targets=targets, capacity=capacity, path=path).where("slot is not null").select("sequence", F.floor(F.col("slot") / run).alias("run"), "slot", "source", "tokens", "container_id"), "p9-mixture")
    sizes = stage(sized(docs, path).select("source", F.least("n_tokens", F.col("n_tokens") % capacity).alias("n_tokens")).where("n_tokens > 0"), "p9-items")
    shares = target_shares(sizes, targets).withColumnRenamed("source", "of")
    runs = placed.groupBy("sequence", "run").agg(F.sum("tokens").alias("all"), F.countDistinct("slot").alias("windows")).where(F.col("windows") == run)
    own = placed.groupBy("sequence", "run", "source").agg(F.sum("tokens").alias("t")).join(runs, ["sequence", "run"])
    drift = own.join(shares, F.col("source").eqNullSafe(F.col("of"))).withColumn("d", F.abs(F.col("t") / F.col("all") - F.col("share")))
    per = drift.groupBy("of").agg(F.count("*").alias("n"), F.sum("d").alias("d"), F.max("d").alias("m"))
    count = runs.count()
    whole = placed.groupBy("source").agg(F.sum("tokens").alias("t"))
    total = placed.agg(F.sum("tokens")).first()[0] or 1
    # Runs without a text of the source are off by its whole share.
    lacking = count - F.coalesce("n", F.lit(0))
    rows = shares.join(per.withColumnRenamed("of", "o"), F.col("of").eqNullSafe(F.col("o")), "left").join(whole, F.col("of").eqNullSafe(F.col("source")), "left")
    mean = (F.coalesce("d", F.lit(0.0)) + lacking * F.col("share")) / F.lit(max(1, count))
    largest = F.greatest(F.coalesce("m", F.lit(0.0)), F.when(lacking > 0, F.col("share")).otherwise(0.0))
    return rows.select(F.col("of").alias("source"), F.round("share", 6).alias("target_share"), F.round(F.coalesce("t", F.lit(0)) / total, 6).alias("share"), F.lit(count).alias("runs"), F.round(mean, 6).alias("mean_drift"), F.round(largest, 6).alias("max_drift"))


def oversized(docs: DataFrame, *, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """doc_id of the texts the packing had to cut."""
    return pack(docs, capacity=capacity, path=path).where(F.col("n_tokens") > capacity).select("doc_id").distinct()


def fill_report(docs: DataFrame, *, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """containers, tokens, share of the capacity used, fewest containers possible, cut texts."""
    placed = stage(pack(docs, capacity=capacity, path=path), "p9-placed")
    cut = placed.where(F.col("n_tokens") > capacity).agg(F.countDistinct("doc_id").alias("cut_texts"))
    used = placed.groupBy("container_id").agg(F.sum("tokens").alias("t"), F.max("tokens").alias("m")).agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return used.crossJoin(cut).select("containers", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("fill"), F.ceil(F.col("tokens") / capacity).alias("least_containers"), "cut_texts")
