"""Word shingles and fast similarity sketches of batches of texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import U64, Rolling, mix

#: Characters of texts handled at once by a worker.
CHARS_AT_ONCE = 1_000_000
_TOP = U64(0xFFFFFFFFFFFFFFFF)


@cache
def _alnum() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about ``CHARS_AT_ONCE`` characters, with the number of the first; null as ''."""
    first, held, part = 0, 0, []
    for i, t in enumerate(texts):
        part.append(t or "")
        held += len(part[-1])
        if held >= CHARS_AT_ONCE:
            yield first, part
            first, held, part = i + 1, 0, []
    if part:
        yield first, part


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word (longest run of letters and digits of the lower-cased text), and its text's number."""
    joined = "\x00".join(texts).lower()
    if joined.count("\x00") >= len(texts):  # a text has the separator itself
        joined = "\x00".join(t.replace("\x00", " ") for t in texts).lower()
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    inside = np.r_[False, _alnum()[chars], False]
    start = np.flatnonzero(inside[1:] & ~inside[:-1])
    end = np.flatnonzero(inside[:-1] & ~inside[1:])
    text = np.searchsorted(np.flatnonzero(chars == 0), start) if len(texts) > 1 else np.zeros(len(start), dtype=np.int64)
    return Rolling(chars).some(start, end), text


def shingles(words: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the sequences of ``size`` consecutive words of one text, and the text's number."""
    n = len(words) - size + 1
    if n <= 0:
        return words[:0], text[:0]
    out = np.zeros(n, dtype=U64)
    for k in range(size):
        out = out * U64(0x9E3779B97F4A7C15) + words[k : k + n]
    same = text[:n] == text[size - 1 :]
    return mix(out[same]), text[:n][same]


def similarity_sketch(items: np.ndarray, text: np.ndarray, texts: int, size: int) -> np.ndarray:
    """A sketch of ``size`` numbers for each text with an item; coordinates agree with the probability of the Jaccard similarity.

    In each of the first ``size`` rounds every item of a text is thrown into one hashed bin, in each
    of the next ``size`` rounds into that round's bin; a bin keeps the least (round, hash) it got. A
    text is done when its bins are full, after about size * log(size) throws; round 2 * size
    leaves none empty.
    """
    sketch = np.full(texts * size, _TOP, dtype=U64)
    for r in range(2 * size):
        if not len(items):
            break
        h = mix(items ^ mix(np.array([r + 1], dtype=U64)))
        value = (U64(r) << U64(32)) | (h & U64(0xFFFFFFFF))
        bins = ((h >> U64(32)) * U64(size) >> U64(32)).astype(np.int64) if r < size else r - size
        np.minimum.at(sketch, text * size + bins, value)
        # Full texts drop out; looking after each of the first rounds would cost more than it saves.
        if r < 4 or r % 3 == 0:
            live = np.unique(text)
            open_ = live[(sketch.reshape(texts, size)[live] == _TOP).any(axis=1)]
            keep = np.zeros(texts, dtype=bool)
            keep[open_] = True
            items, text = items[keep[text]], text[keep[text]]
    return sketch.reshape(texts, size)


def band_partitions(df: DataFrame, rows_each: int, bytes_each: int = 16_000_000, most: int = 50_000) -> int:
    """Partitions for ``rows_each`` band rows (about 24 bytes) of each row of ``df``, from its size instead of the session's default."""
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(default, -(-df.count() * rows_each * 24 // bytes_each)))


def band_rows(df: DataFrame, bands: int, rows: int, shingle: int = 3, side: int = 0) -> DataFrame:
    """``band``, ``tid`` of each text of ``df`` (``tid`` long, ``part`` int, ``text``) for each band of its sketch.

    The band's last bit is ``side``. Texts of different ``part`` never share a band. Texts without a shingle have none. A tid that comes again in
    one task is passed over.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            batch = batch.select(["tid", "part", "text"])
            new = []
            for i, t in enumerate(batch.column(0).to_pylist()):
                if t not in seen:
                    seen.add(t)
                    new.append(i)
            if not new:
                continue
            batch = batch.take(pa.array(new))
            tids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, texts in chunks(batch.column(2).to_pylist()):
                items, text = shingles(*word_hashes(texts), shingle)
                some = np.unique(text)
                if not len(some):
                    continue
                number = np.zeros(len(texts), dtype=np.int64)
                number[some] = np.arange(len(some))
                sketch = similarity_sketch(items, number[text], len(some), bands * rows)
                salt = mix(parts[first + some].astype(U64) * U64(1 << 20) + U64(1))[:, None] + mix(np.arange(bands, dtype=U64))[None, :]
                key = salt
                for r in range(rows):
                    key = mix(key) + sketch.reshape(len(some), bands, rows)[:, :, r]
                yield pa.RecordBatch.from_arrays([pa.array((mix(key) & ~U64(1) | U64(side)).view(np.int64).reshape(-1)), pa.array(np.repeat(tids[first + some], bands))], names=["band", "tid"])

    return df.select("tid", "part", "text").mapInArrow(make, "band long, tid long")
