"""Array views of text batches: words, lines and their 64-bit hashes, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

# Texts are worked on in groups of about this many bytes, which bounds a task's memory.
CHUNK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < max(n, 1):
        size = max(n, CHUNK_BYTES)
        for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, factor & _MASK, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"][:n], _tables["down"][:n]


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


class Texts:
    """A batch of texts as one byte array; a null text has no bytes."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        raw = pc.fill_null(column.cast(pa.large_string()).cast(pa.large_binary()), b"")
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
        body = raw.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
        data = data[offsets[0]:offsets[-1]]
        self.data = LOWER[data] if lower else data
        self.bounds = offsets - offsets[0]
        self.n = len(raw)
        self._prefix: np.ndarray | None = None

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of marked bytes, cut at text borders."""
        if not len(inside):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        border = np.zeros(len(inside) + 1, bool)
        border[self.bounds] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | border[1:-1]
        end[:-1] &= ~inside[1:] | border[1:-1]
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.spans(~WHITE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and owning text of all ``\\n``-split lines; a text without bytes has none."""
        breaks = np.flatnonzero(self.data == 10)
        full = np.flatnonzero(np.diff(self.bounds) > 0)
        starts = np.concatenate([self.bounds[full], breaks + 1])
        owner = np.concatenate([full, self.owner(breaks)])
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        ends = np.empty_like(starts)
        if len(starts):
            ends[:-1] = np.where(owner[1:] == owner[:-1], starts[1:] - 1, self.bounds[owner[:-1] + 1])
            ends[-1] = self.bounds[owner[-1] + 1]
        return starts, ends, owner

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, positions, side="right") - 1

    def per_text(self, positions: np.ndarray) -> np.ndarray:
        """Borders of the texts within a sorted list of byte positions."""
        return np.searchsorted(positions, self.bounds)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte span; equal bytes give equal hashes wherever they stand."""
        if self._prefix is None:
            self._prefix = rolling(self.data)
        return span_hashes(self._prefix, starts, ends)


def rolling(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums from which ``span_hashes`` takes any span."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(len(values))[0], out=prefix[1:])
    return prefix


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    rolled = (prefix[ends] - prefix[starts]) * _powers(len(prefix))[1][starts]
    return mix(rolled + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (the order of the words counts)."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[k:k + n]
    return mix(out)


def sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sum of consecutive values between borders; empty stretches give 0."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[borders[1:]] - total[borders[:-1]]


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most ``limit`` text bytes, or with one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def annotate(df: DataFrame, column: str, compute: Callable[[pa.Array], list], added: str,
             keep: list[str] | None = None) -> DataFrame:
    """Add the columns that ``compute`` makes from a text column; ``added`` is their DDL.

    ``keep`` lists the input columns to pass on (all by default). An input column with the name of
    an added one is replaced by it.
    """
    new = T.StructType.fromDDL(added)
    taken = {f.name.lower() for f in new}
    passed = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    source = df.select(*[df[f"`{c}`"] for c in dict.fromkeys([*passed, column])])
    schema = T.StructType([*[source.schema[c] for c in passed], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                made = [a if isinstance(a, pa.Array) else pa.array(a) for a in compute(part.column(column))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in passed], *made],
                                                 [*passed, *new.names])

    return source.mapInArrow(run, schema)
