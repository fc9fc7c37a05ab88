"""Small helpers shared by the operators of this subpackage (all run inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entries a worker process keeps in a word cache before it starts over; bounds memory only.
CACHE_ENTRIES = 400_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: null)."""

    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def utf8_values(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column, without decoding."""

    return column.cast(pa.binary()).to_pylist()


def bytes_of(values: pa.Array) -> list[bytes]:
    """The values of a large string array without nulls as bytes; cut from its buffer, much faster than one Arrow scalar each."""

    ends = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset).tolist() if len(values) else [0]
    data = memoryview(values.buffers()[2] or b"")[ends[0] : ends[-1]].tobytes()
    base = ends[0]
    return [data[a - base : b - base] for a, b in pairwise(ends)]


@dataclass
class Words:
    """The words of a run of texts: text i has ``codes[starts[i]:starts[i + 1]]``,
    indices into the distinct words (kept as bytes in ``distinct``)."""

    starts: np.ndarray
    codes: np.ndarray
    distinct: list[bytes]

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word occurrence."""

        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct), np.uint64, len(self.distinct))[self.codes]


def words_of(column: pa.Array, lower: bool = True) -> Words:
    """Words ``[^\x20\x09-\x0D]+`` of each text (none for null), A-Z lower-cased if asked for.

    Arrow's ASCII functions cut at exactly those six bytes and change A-Z only.
    """

    # Arrow's ascii_lower is wrong on an array that is a slice of another: copy the rows first
    text = pc.fill_null(column.take(pa.array(np.arange(len(column)))), "").cast(pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    values, offsets = split.values, np.asarray(split.offsets, dtype=np.int64)
    full = np.asarray(pc.greater(pc.binary_length(values), 0))
    if not full.all():  # white space at either end of a text leaves an empty word there
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        values = values.filter(pa.array(full))
    coded = values.dictionary_encode()
    return Words(offsets, np.asarray(coded.indices), bytes_of(coded.dictionary))


def slices(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice of several rows has more than ``most_bytes`` in ``column``."""

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        within = np.searchsorted(np.cumsum(sizes[start:]), most_bytes, side="right")
        yield batch.slice(start, max(1, int(within)))
        start += max(1, int(within))


def mixed(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""

    values = values ^ (values >> np.uint64(33))
    values = values * _MIX
    return values ^ (values >> np.uint64(29))


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per ``size``-word window in text order; a shorter text is one window; no words, none."""

    if not len(word_hashes):
        return word_hashes
    width = min(size, len(word_hashes))
    count = len(word_hashes) - width + 1
    out = np.full(count, np.uint64(width), np.uint64)
    for offset in range(width):
        out = out * _MULTIPLIER + word_hashes[offset : offset + count]
        out ^= out >> np.uint64(31)
    return mixed(out)
