"""Problem 8: encoding of the whole corpus with a public tokenizer.

Texts are encoded in Arrow batches.  A text longer than ``LONG`` characters is
cut in pieces that are encoded in parallel; neighbours are then joined in a tree.
At a join a window around it is encoded again.  It grows until it begins and
ends at places where the tokenizer's pattern always splits: behind a run of
letters or digits, or before a single space between other characters.  The
window's tokens are then the tokens of the whole text there, so the result is
that of encoding the text at once.  A piece of the pattern that runs over the join,
of whatever kind and length, is not encoded again: the tokens of its halves are
joined, until both border pairs are what the merge rules make of them; adjacent
pairs that hold make a sequence the only encoding.

Null and empty texts have an empty list.  Special tokens in a text are ordinary
text.  Lone surrogates cannot occur in Parquet strings.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's split pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CERTAIN = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?= \S)")
LONG = 1 << 14
_WINDOW = 64


PIECE = regex.compile(PATTERN)


@functools.lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    """The encoding of a vocabulary file; loaded once a Python worker."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc.token_sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        enc.token_sizes[i] = len(token)
    return enc


def _tokens_of(enc, ids: list[int], size: int, *, end: bool) -> int:
    """How many tokens at the end (or the beginning) of ``ids`` make up ``size`` bytes."""
    if not size:
        return 0
    sizes = np.cumsum(enc.token_sizes[np.array(ids[::-1] if end else ids)])
    at = int(np.searchsorted(sizes, size))
    if at == len(sizes) or sizes[at] != size:
        raise ValueError("no token ends at a certain split")
    return at + 1


def _pair_holds(enc, left: int, right: int) -> bool:
    pair = enc.decode_single_token_bytes(left) + enc.decode_single_token_bytes(right)
    return enc._encode_single_piece(pair) == [left, right]


def _join_run(enc, left: list[int], right: list[int]) -> list[int]:
    """Tokens of one unsplit run from those of its halves."""
    w = _WINDOW
    while True:
        a, b = max(0, len(left) - w), min(len(right), w)
        middle = enc._encode_single_piece(b"".join(map(enc.decode_single_token_bytes, left[a:] + right[:b])))
        if (a == 0 or _pair_holds(enc, left[a - 1], middle[0])) and (b == len(right) or _pair_holds(enc, middle[-1], right[b])):
            return left[:a] + middle + right[b:]
        w *= 2


def join_halves(enc, left_text: str, left: list[int], right_text: str, right: list[int]) -> list[int]:
    """Tokens of left_text + right_text from the tokens of both."""
    if not left_text or not right_text:
        return left + right
    w = _WINDOW
    while True:
        tail, head = left_text[-w:], right_text[:w]
        start = next((m.start() for m in CERTAIN.finditer(tail)), None)
        stop = None
        for m in CERTAIN.finditer(head):
            stop = m.start()
        whole_left, whole_right = len(tail) == len(left_text), len(head) == len(right_text)
        if (start is not None or whole_left) and (stop is not None or whole_right):
            break
        w *= 4
    start = 0 if start is None else start
    stop = len(head) if stop is None else stop
    behind, before = tail[start:], head[:stop]
    # Both cuts are certain splits, so each side's tokens fall apart there.
    cut_left = len(left) - _tokens_of(enc, left, len(behind.encode()), end=True)
    cut_right = _tokens_of(enc, right, len(before.encode()), end=False)
    return left[:cut_left] + _join_pieces(enc, behind, left[cut_left:], before, right[:cut_right]) + right[cut_right:]


def _join_pieces(enc, behind: str, left: list[int], before: str, right: list[int]) -> list[int]:
    """Tokens of behind + before, which are split for certain at both ends, from the tokens of both."""
    at = len(behind)
    whole = [m.span() for m in PIECE.finditer(behind + before)]
    over = next((k for k, (a, b) in enumerate(whole) if a < at < b), None)
    mine, other = [m.span() for m in PIECE.finditer(behind)], [(a + at, b + at) for a, b in (m.span() for m in PIECE.finditer(before))]
    if over is None:
        same = whole == mine + other
        return left + right if same else enc.encode_ordinary(behind + before)
    a, b = whole[over]
    if mine != whole[:over] + [(a, at)] or other != [(at, b)] + whole[over + 1 :]:
        return enc.encode_ordinary(behind + before)
    cut_left = len(left) - _tokens_of(enc, left, len(behind[a:].encode()), end=True)
    cut_right = _tokens_of(enc, right, len(before[: b - at].encode()), end=False)
    joined = _join_run(enc, left[cut_left:], right[:cut_right])
    return left[:cut_left] + joined + right[cut_right:]


def _encode_column(df: DataFrame, key: str, text: str, path: str, extra: list[str]) -> DataFrame:
    """key, extra columns, text, ids."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [key, *extra, text]
    schema = ", ".join(f"`{n}` {fields[n]}" for n in names) + ", ids array<int>"

    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(ids, pa.list_(pa.int32()))], names=[*names, "ids"])

    return df.select(*names).mapInArrow(run, schema)


def _long_ids(rows: DataFrame, path: str, long: int) -> DataFrame:
    """key, ids of long texts by tree concatenation; one row a row of ``rows``.

    A text is encoded once, under its hash: keys may be null or recur.
    """
    rows = rows.withColumn("hash", F.sha2("text", 256))
    pieces = F.ceil(F.length("text") / long).cast("int")
    # Not before the second half of a surrogate pair: Spark counts code points, so any cut is whole characters.
    cut = rows.select("hash", F.posexplode(F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substring(F.col("text"), i * long + 1, F.lit(long)))).alias("i", "text"))
    parts = _encode_column(cut.dropDuplicates(["hash", "i"]), "hash", "text", path, ["i"])
    depth = rows.agg(F.max(pieces)).first()[0] or 1
    schema = "hash string, i int, text string, ids array<int>"

    def join(table):
        import pyarrow as pa

        enc = encoder(path)
        table = table.sort_by("i")
        rows = table.to_pylist()
        if len(rows) > 2 or len(rows) == 2 and rows[0]["i"] + 1 != rows[1]["i"]:
            raise ValueError(f"pieces {[r['i'] for r in rows]} of a text in one join")
        if len(rows) == 2:
            a, b = rows
            ids = join_halves(enc, a["text"], a["ids"], b["text"], b["ids"])
            text = a["text"] + b["text"]
        else:
            ids, text = rows[0]["ids"], rows[0]["text"]
        kind = table.schema
        return pa.table({"hash": pa.array([rows[0]["hash"]], kind.field("hash").type), "i": pa.array([rows[0]["i"] // 2], pa.int32()), "text": pa.array([text], kind.field("text").type), "ids": pa.array([ids], pa.list_(pa.int32()))})

    while depth > 1:
        parts = parts.withColumn("half", F.col("i").bitwiseAND(F.lit(-2))).groupBy("hash", "half").applyInArrow(lambda t: join(t.drop_columns(["half"])), schema)
        depth = -(-depth // 2)
    return rows.select("key", "hash").join(parts.select("hash", "ids"), "hash").select("key", "ids")


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", *, path: str = VOCABULARY, long: int = LONG) -> DataFrame:
    """key, ids: token ids of every row's text; one row a row of ``docs``."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    short = _encode_column(rows.where(~is_long), "key", "text", path, []).select("key", "ids")
    return short.unionAll(_long_ids(rows.where(is_long), path, long)).withColumnRenamed("key", key)


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of a text (0 for null), as an Arrow UDF column."""
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)
