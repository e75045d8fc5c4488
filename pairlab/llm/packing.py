"""Filling containers of a fixed number of tokens.

Items are spread over blocks by a hash of their id, text and number among copies; a block is filled by Karmarkar-Karp
differencing over several windows: the two partial partitions with the largest spread are
merged, the largest window of one with the smallest of the other, until one is left with
nearly equal windows. The number of windows starts at the least possible and rises while a
window exceeds the capacity.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut

_ENCODINGS: dict = {}


def public_tokenizer(path: str | None = None):
    """A byte-level tokenizer from a file of ranks; without a path, the installed public one."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str | None = None) -> DataFrame:
    """``rec``, ``text_key`` (a hash of the text) and ``n_tokens`` of each row with an id and a text that isn't empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = public_tokenizer(tokenizer_path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["rec", "text_key", "n_tokens"])

    source = df.select(F.col(id_col).alias("rec"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).where("rec is not null and text <> ''")
    return source.mapInArrow(count, f"rec {dict(source.dtypes)['rec']}, text_key long, n_tokens long")


def _numbered(counts: DataFrame, at_once: int = 10_000) -> DataFrame:
    """``counts`` with ``copy``: rows with the same id and text are numbered from 0.

    They are counted, then made again in runs of ``at_once``, so rows that are all alike fill many tasks."""
    keys = ["rec", "text_key", "n_tokens"]
    same = counts.groupBy(*keys).agg(F.count("*").alias("c"))
    runs = same.select(*keys, "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(at_once).cast("long"))).alias("from"))
    several = runs.where(F.col("c") > at_once).repartition("rec", "text_key", "from")
    spread = runs.where(F.col("c") <= at_once).unionByName(several)
    return spread.select(*keys, F.explode(F.sequence("from", F.least(F.col("from") + at_once, F.col("c")) - 1)).alias("copy"))


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, int]:
    """Karmarkar-Karp: a window for each size, and the largest window's sum.

    A partial partition is kept as its non-empty windows, largest first; equal spreads are
    taken in the order they arose, so the result is the same in every run.
    """
    if windows <= 1 or len(sizes) <= 1:
        return np.zeros(len(sizes), dtype=np.int64), int(sizes.sum())
    after = np.full(len(sizes), -1, dtype=np.int64)  # items of one window, as linked lists
    order = np.argsort(-sizes, kind="stable")
    heap: list = [(-int(sizes[i]), n, 0) for n, i in enumerate(order)]
    parts: dict = {n: (np.array([sizes[i]]), np.array([i]), np.array([i])) for n, i in enumerate(order)}
    heapq.heapify(heap)
    count = len(order)
    while len(heap) > 1:
        a, b = parts.pop(heapq.heappop(heap)[1]), parts.pop(heapq.heappop(heap)[1])
        room = windows - len(a[0])
        overlap = len(b[0]) - room
        if overlap <= 0:
            total, head, tail = (np.concatenate(x) for x in zip(a, b))
        else:
            # The largest windows of b go to empty ones, the rest to the smallest of a, crosswise.
            mine, theirs = np.arange(len(a[0]) - overlap, len(a[0]))[::-1], np.arange(room, len(b[0]))
            after[a[2][mine]] = b[1][theirs]
            total, tail = a[0].copy(), a[2].copy()
            total[mine] += b[0][theirs]
            tail[mine] = b[2][theirs]
            total, head, tail = np.concatenate([total, b[0][:room]]), np.concatenate([a[1], b[1][:room]]), np.concatenate([tail, b[2][:room]])
        sort = np.argsort(-total, kind="stable")
        total, head, tail = total[sort], head[sort], tail[sort]
        parts[count] = (total, head, tail)
        least = int(total[-1]) if len(total) == windows else 0
        heapq.heappush(heap, (least - int(total[0]), count, 0))
        count += 1
    total, head, _ = parts[heap[0][1]]
    place = np.zeros(len(sizes), dtype=np.int64)
    for w, i in enumerate(head):
        while i >= 0:
            place[i] = w
            i = after[i]
    return place, int(total.max())


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A window for each size, none above ``capacity``; no size may be above it."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        place, largest = difference(sizes, windows)
        if largest <= capacity:
            return place
        windows += max(1, windows // 200)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer_path: str | None = None, windows_per_block: int = 128) -> DataFrame:
    """A container for each item: ``container_id`` STRING, ``id_col``, ``text_key`` and ``copy`` BIGINT, ``piece`` INT,
    ``first_token`` and ``n_tokens`` BIGINT, ``container_tokens`` BIGINT.

    An item is whole (piece 0) unless it has more than ``capacity`` tokens; then it is cut into full
    containers and a rest that is packed like other items. Null and empty texts and rows with a
    null id get no container; repeated rows are items of their own: ``text_key`` tells rows with the same id apart
    by their text, ``copy`` numbers those with the same text. The result depends on the ids
    and texts only, not on partitions or the order of rows.
    """
    item = ["rec", "text_key", "copy"]
    counts = cut(_numbered(token_counts(df, id_col, text_col, tokenizer_path).where("n_tokens > 0")))
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    whole = counts.where(F.col("n_tokens") >= capacity).select(*item, F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    name = F.concat_ws("-", F.lit("full"), F.col("rec").cast("string"), F.lower(F.hex("text_key")), F.col("copy").cast("string"), F.col("piece").cast("string"))
    size = F.lit(capacity).cast("long")
    whole = whole.select(name.alias("container_id"), *item, "piece", (F.col("piece") * size).alias("first_token"), size.alias("n_tokens"), size.alias("container_tokens"))
    rest = counts.select(*item, full.alias("piece"), (full * size).alias("first_token"), (F.col("n_tokens") % capacity).alias("n_tokens")).where("n_tokens > 0")
    total = rest.agg(F.sum("n_tokens").alias("n")).first().n or 0
    blocks = max(1, -(-total // (capacity * windows_per_block)))
    kind = dict(counts.dtypes)["rec"]

    def pack_block(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["n_tokens", "rec", "text_key", "copy"], ascending=[False, True, True, True], kind="stable")
        block["slot"] = fill(block["n_tokens"].to_numpy(), capacity)
        block["container_id"] = f"{key[0]}-" + block["slot"].astype(str)
        block["container_tokens"] = block.groupby("slot")["n_tokens"].transform("sum")
        return block[["container_id", *item, "piece", "first_token", "n_tokens", "container_tokens"]]

    # Blocks hold about the same number of tokens, as every item is hashed, copies apart; none grows with the data.
    blocked = rest.withColumn("block", F.pmod(F.xxhash64(*item), F.lit(blocks)))
    # The rows of a block are few bytes and much work, so their partitions aren't merged by size.
    spread = blocked.repartition(min(blocks, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block")
    packed = spread.groupBy("block").applyInPandas(pack_block, f"container_id string, rec {kind}, text_key long, copy long, piece int, first_token long, n_tokens long, container_tokens long")
    return whole.unionByName(packed).withColumnRenamed("rec", id_col)


def pack_fill(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, **options) -> DataFrame:
    """How full the containers are: ``containers``, ``tokens``, ``least_containers``, ``fill`` (null without items)."""
    boxes = pack(df, id_col, text_col, capacity, **options).groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    return boxes.agg(F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.ceil(F.sum("t") / capacity), F.lit(0)).alias("least_containers"), F.round(F.sum("t") / (F.count("*") * capacity), 6).alias("fill"))


def pack_audit(packed: DataFrame, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """One row that checks a packing: ``items`` and ``rows`` that should be there, ``overfull`` containers, ``wrong_totals``,
    items with a ``gap`` (tokens left out, twice or out of order) and items ``cut`` though they fit."""
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.max("container_tokens").alias("told"))
    bad = boxes.agg(F.count_if(F.col("t") > capacity).alias("overfull"), F.count_if(F.col("t") != F.col("told")).alias("wrong_totals"))
    pieces = packed.groupBy(id_col, "text_key", "copy").agg(F.count("*").alias("k"), F.max("piece").alias("last"), F.sum("n_tokens").alias("t"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count_if(F.col("first_token") != F.col("piece") * capacity).alias("moved"))
    told = pieces.agg(F.count("*").alias("items"), F.count_if((F.col("k") != F.col("last") + 1) | (F.col("t") != F.col("end")) | (F.col("moved") > 0)).alias("gap"), F.count_if((F.col("k") > 1) & (F.col("t") <= capacity)).alias("cut"))
    rows = df.agg(F.count_if(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).alias("rows"))
    return told.crossJoin(rows).crossJoin(bad)
