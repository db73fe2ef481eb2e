"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut where no piece can cross, equal fragments of a batch are encoded once, and fragments of
equal length advance through the lattice together: substring hashes probe the sorted piece keys, and
vectorised maxima store one backpointer per position.

A unigram model takes the path with the largest sum of scores. For a byte-pair model that sum is not
what its merges produce, so an edge is admitted only if it can follow the edge before it: merging
the two pieces' characters on their own must give back these two pieces. Exactly one path has this
property, the result of the merges. Verdicts on pairs of pieces are kept per worker.

Nulls and edges: a null text gives null, an empty one no pieces. Characters without a piece become
their UTF-8 byte pieces. U+2581 in a text is a space to this model family and decodes as one. Very
long texts are encoded whole. Repeated rows are encoded alike. Input columns named like an added one
are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from couplet.llm.texts import mix, rolling, slices, span_hashes

SPACE = 0x2581
TEXT_BYTES = 1 << 20       # texts encoded at a time
CACHE_UNITS = 250_000      # fragments remembered per worker before it starts afresh
PAIR_SLOTS = 1 << 20       # slots for verdicts on pairs; half full, the table starts afresh
LONG_UNIT = 64             # longer fragments are cut further, at character pairs that no piece holds


class PieceTable:
    """Pieces, scores and lookup keys of a model; small enough to travel with a task."""

    def __init__(self, pieces: list[str], scores: list[float], special: list[bool], byte_ids: list[int],
                 algorithm: str = "bpe"):
        self.pieces, self.algorithm = pieces, algorithm
        self.scores = np.asarray(scores, np.float64)
        self.byte_ids = np.asarray(byte_ids, np.int32)
        usable = [i for i in range(len(pieces)) if not special[i] and pieces[i]]
        self.score_of = {pieces[i]: scores[i] for i in usable}
        self.longest = max((len(pieces[i]) for i in usable), default=1)
        cps = [np.frombuffer(pieces[i].encode("utf-32-le"), np.uint32) for i in usable]
        sizes = np.array([len(c) for c in cps])
        flat = np.concatenate(cps)
        ends = np.cumsum(sizes)
        keys = span_hashes(rolling(flat), ends - sizes, ends)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.asarray(usable, np.int32)[order]
        self.likely = np.zeros(1 << 20, bool)              # by the top bits of a key, to skip most probes
        self.likely[self.keys >> np.uint64(44)] = True
        inner = np.ones(len(flat) - 1, bool)
        inner[ends[:-1] - 1] = False
        self.bigrams = np.unique((flat[:-1].astype(np.int64)[inner] << 21) | flat[1:].astype(np.int64)[inner])
        self.known = np.zeros(0x110000, bool)
        self.known[flat] = True
        # A fragment may begin at a space if no piece holds a space after another character.
        self.cut_at_space = not (((self.bigrams & ((1 << 21) - 1)) == SPACE) & ((self.bigrams >> 21) != SPACE)).any()
        special_bytes = {i: bytes([b]) for b, i in enumerate(byte_ids)} if len(byte_ids) == 256 else {}
        out = [special_bytes.get(i, b"" if special[i] else p.replace(chr(SPACE), " ").encode())
               for i, p in enumerate(pieces)]
        self.out_sizes = np.array([len(o) for o in out])
        self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.unknown = len(pieces)
        self.name = f"{algorithm}-{int(self.keys.sum()):x}-{self.scores.sum()!r}"
        self._reset()

    def _reset(self) -> None:
        self._units: dict[int, int] = {}
        self._starts, self._sizes, self._store = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))
        self._pairs: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items()
                if k not in ("_units", "_starts", "_sizes", "_store", "_pairs", "_pair_ok", "_pair_count")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    @classmethod
    def load(cls, model_file: str, algorithm: str = "bpe") -> PieceTable:
        """Read the vocabulary of a model file on the driver; ``algorithm`` is ``bpe`` or ``unigram``."""
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = m.get_piece_size()
        special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i) for i in range(n)]
        bytes_ = [i for i in range(n) if m.is_byte(i)]
        return cls([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], special, bytes_, algorithm)

    # -- byte-pair admissibility ----------------------------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """The merges of a short text: the best-scored adjacent pair first, the leftmost of equals."""
        parts, score_of = list(text), self.score_of
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score_of.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, before: int, piece: int) -> bool:
        right = self.pieces[piece]
        if before < 0:
            return self._merged(right) == [right]
        left = self.pieces[before]
        return self._merged(left + right) == [left, right]

    def _admitted(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the piece before it (-1: none)."""
        if self._pairs is None or self._pair_count > PAIR_SLOTS // 2:
            self._pairs, self._pair_ok = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
            self._pair_count = 0
        base = self.unknown + 2
        keys = (before + 1).astype(np.int64) * base + piece
        slots, known = self._slots(keys)
        if not known.all():
            new = np.unique(keys[~known])
            ok = [self._fits(int(k // base) - 1, int(k % base)) for k in new]
            for k, fits, slot in zip(new.tolist(), ok, self._slots(new)[0].tolist()):
                while self._pairs[slot] >= 0:              # an earlier one of the new keys took it
                    slot = (slot + 1) % PAIR_SLOTS
                self._pairs[slot], self._pair_ok[slot] = k, fits
            self._pair_count += len(new)
            slots, _ = self._slots(keys)
        return self._pair_ok[slots]

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key, or the free slot where its search ends."""
        slots = (mix(keys.view(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        held = self._pairs[slots]
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) % PAIR_SLOTS
            held[open_] = self._pairs[slots[open_]]
            open_ = open_[(held[open_] != keys[open_]) & (held[open_] >= 0)]
        return slots, held == keys

    # -- lattice --------------------------------------------------------------------------------------

    def _viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of words of one length (one row of code points each), in a row, and their number per word."""
        m, n = words.shape
        width = min(self.longest, n)
        prefix = rolling(words.ravel())
        base = (np.arange(m) * n)[:, None, None]
        end = np.arange(1, n + 1)[None, :, None]
        start = end - np.arange(1, width + 1)[None, None, :]
        inside = np.broadcast_to(start >= 0, (m, n, width))
        h = span_hashes(prefix, (base + np.maximum(start, 0)).ravel(), np.broadcast_to(base + end, inside.shape).ravel())
        probe = np.flatnonzero(inside.ravel() & self.likely[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, h[probe]), len(self.keys) - 1)
        hit = self.keys[at] == h[probe]
        found = np.full(len(h), -1, np.int32)
        found[probe[hit]] = self.ids[at[hit]]
        found = found.reshape(inside.shape)
        lonely = found[:, :, 0] < 0
        found[:, :, 0] = np.where(lonely, self.unknown, found[:, :, 0])
        weight = np.append(self.scores, self.scores.min() - 10.0)

        last = np.full((m, n + 1), -1, np.int32)
        total = np.full((m, n + 1), -np.inf)
        total[:, 0] = 0.0
        step = np.zeros((m, n + 1), np.int32)
        for e in range(1, n + 1):
            k = min(width, e)
            piece = found[:, e - 1, :k]
            came = np.arange(e - 1, e - 1 - k, -1)
            row, back = np.nonzero((piece >= 0) & (total[:, came] > -np.inf))
            this, before = piece[row, back], last[row, came[back]]
            if self.algorithm == "bpe":
                plain = this < self.unknown
                fit = np.ones(len(this), bool)
                fit[plain] = self._admitted(np.where(before[plain] < self.unknown, before[plain], -1), this[plain])
                row, back, this = row[fit], back[fit], this[fit]
            value = np.full((m, k), -np.inf)
            value[row, back] = total[row, came[back]] + weight[this]
            best = value.argmax(axis=1)
            total[:, e] = value[np.arange(m), best]
            step[:, e] = best + 1
            last[:, e] = piece[np.arange(m), best]

        where, active = np.full(m, n), np.arange(m)
        trail_ids, trail_rows = [], []
        while len(active):
            trail_rows.append(active)
            trail_ids.append(np.stack([last[active, where[active]], where[active]], axis=1))
            where[active] -= step[active, where[active]]
            active = active[where[active] > 0]
        rows, pairs = np.concatenate(trail_rows), np.concatenate(trail_ids)
        order = np.lexsort((pairs[:, 1], rows))
        rows, ids, ends = rows[order], pairs[order, 0].astype(np.int32), pairs[order, 1]
        unknown = np.flatnonzero(ids == self.unknown)
        if not len(unknown):
            return ids, np.bincount(rows, minlength=m)
        if not len(self.byte_ids):
            ids[unknown] = 0
            return ids, np.bincount(rows, minlength=m)
        raw = [chr(words[rows[i], ends[i] - 1]).encode("utf-8", "replace") for i in unknown]
        sizes = np.ones(len(ids), np.int64)
        sizes[unknown] = [len(r) for r in raw]
        wide = np.repeat(ids, sizes)
        at = np.repeat(np.isin(np.arange(len(ids)), unknown), sizes)
        wide[at] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return wide, np.bincount(np.repeat(rows, sizes), minlength=m)

    def _cuts(self, cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Positions where a fragment begins: text starts, spaces after other characters, unknown characters."""
        begin = np.zeros(len(cps) + 1, bool)
        begin[starts] = True
        loose = ~self.known[cps]
        begin[:-1] |= loose
        begin[1:] |= loose
        if self.cut_at_space:
            space = cps == SPACE
            begin[1:-1] |= space[1:] & ~space[:-1]
        at = np.flatnonzero(begin[:-1])
        sizes = np.diff(np.append(at, len(cps)))
        for s, size in zip(at[sizes > LONG_UNIT], sizes[sizes > LONG_UNIT]):
            part = cps[s:s + size].astype(np.int64)
            pair = (part[:-1] << 21) | part[1:]
            hit = np.minimum(np.searchsorted(self.bigrams, pair), len(self.bigrams) - 1)
            begin[s + 1:s + size] |= self.bigrams[hit] != pair
        return np.flatnonzero(begin[:-1])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in a row, and the borders of each text."""
        joined = "".join(chr(SPACE) + t for t in texts if t).replace(" ", chr(SPACE))
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        text_sizes = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(text_sizes)])
        if not len(cps):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = self._cuts(cps, bounds[:-1][text_sizes > 0])
        ends = np.append(starts[1:], len(cps))
        h = span_hashes(rolling(cps), starts, ends)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self._units) + len(unique) > CACHE_UNITS:
            self._reset()
        keys, units = unique.tolist(), self._units
        new = np.array([i for i, k in enumerate(keys) if k not in units], np.int64)
        s, e = starts[first[new]], ends[first[new]]
        length = e - s
        added, added_sizes = [self._store], [self._sizes]
        for n in np.unique(length):
            group = np.flatnonzero(length == n)
            block = max(1, (1 << 20) // int(n * min(n, self.longest)))
            for b in range(0, len(group), block):
                rows = group[b:b + block]
                ids, sizes = self._viterbi(cps[s[rows][:, None] + np.arange(n)[None, :]])
                units.update(zip(unique[new[rows]].tolist(), range(len(units), len(units) + len(rows))))
                added.append(ids)
                added_sizes.append(sizes)
        self._store, self._sizes = np.concatenate(added), np.concatenate(added_sizes)
        self._starts = np.cumsum(self._sizes) - self._sizes
        own = np.fromiter((units[k] for k in keys), np.int64, len(keys))
        own_sizes, begin, flat = self._sizes[own], self._starts[own], self._store
        counts = own_sizes[inverse]
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        gather = np.repeat(begin[inverse] - upto[:-1], counts) + np.arange(upto[-1])
        return flat[gather], upto[np.searchsorted(starts, bounds)]

    def decode(self, ids: np.ndarray, borders: np.ndarray) -> list[str]:
        """Texts of consecutive id lists; the space that encoding puts in front goes."""
        sizes = self.out_sizes[ids]
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        at = np.repeat(self.out_starts[ids] - upto[:-1], sizes) + np.arange(upto[-1])
        raw = self.out_bytes[at].tobytes()
        limits = upto[borders]
        return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(limits[:-1], limits[1:])]


_resident: dict[str, PieceTable] = {}


def resident(table: PieceTable) -> PieceTable:
    """The worker's own copy of a table, which keeps what earlier tasks have encoded."""
    return _resident.setdefault(table.name, table)


def encode(df: DataFrame, table: PieceTable, text: str = "text", out: str = "piece_ids",
           keep: list[str] | None = None) -> DataFrame:
    """Add ``out`` (array of int), the piece ids of the whole text."""
    passed = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    source = df.select(*[df[f"`{c}`"] for c in dict.fromkeys([*passed, text])])
    schema = T.StructType([*[source.schema[c] for c in passed], T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, TEXT_BYTES):
                column = part.column(text)
                ids, borders = resident(table).encode(column.to_pylist())
                offsets = pa.array(borders.astype(np.int32), mask=None)
                if column.null_count:
                    null = np.append(np.asarray(column.is_null()), False)
                    offsets = pa.array(borders.astype(np.int32), mask=null)
                made = pa.ListArray.from_arrays(offsets, pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in passed], made], [*passed, out])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, table: PieceTable, ids: str = "piece_ids", out: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """Add ``out``, the text that a column of piece ids stands for."""
    passed = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    source = df.select(*[df[f"`{c}`"] for c in dict.fromkeys([*passed, ids])])
    schema = T.StructType([*[source.schema[c] for c in passed], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                column = part.column(ids)
                sizes = np.array([0 if v is None else len(v) for v in column.to_numpy(zero_copy_only=False)], np.int64)
                texts = table.decode(column.flatten().to_numpy(), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]))
                made = pa.array([t if v else None for t, v in zip(texts, np.asarray(column.is_valid()))], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in passed], made], [*passed, out])

    return source.mapInArrow(run, schema)


def round_trip(df: DataFrame, table: PieceTable, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_pieces, pieces_sha256, round_trip)``: texts encoded, digested and decoded in one pass.

    The digest is of the ids as little-endian 32-bit integers. ``round_trip`` tells whether decoding
    gives the text back (null for a null text).
    """
    source = df.select(id, text)
    schema = T.StructType([source.schema[id], *T.StructType.fromDDL(
        "n_pieces long, pieces_sha256 string, round_trip boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, TEXT_BYTES):
                known, texts = resident(table), part.column(text).to_pylist()
                ids, borders = known.encode(texts)
                back = known.decode(ids, borders)
                raw = ids.astype("<i4").tobytes()
                digests = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(borders[:-1], borders[1:])]
                same = [None if t is None else t == b for t, b in zip(texts, back)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id), pa.array(np.diff(borders)), pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
                    schema.names)

    return source.mapInArrow(run, schema)
