"""Byte-level BPE encoding and decoding with a segment tree.

The text is cut into pieces by the vocabulary's pattern; each piece is merged
on its own. A piece's tree has a leaf for each byte position: the rank of the
pair that starts there, made unique by the position, so the root is the
leftmost pair of the lowest rank. A merge sets the leaves of the merged
position, of its live left neighbour and of the position that died, and
repairs the paths above these three: O(log n) for each merge, O(n log n) for a
piece of n bytes. Short pieces are merged many at a time, one row of a numpy
matrix for each tree; long ones (a text without any blank) one by one.

Defined results: a null text is the empty text, which has no ids; ids outside
the vocabulary raise when decoding; repeated rows give repeated results; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from readloom.llm.arrow import at_end, by_bytes, sizes_of, tidy
from readloom.session import ship

_WIDTHS = (8, 16, 32, 64)
_BLOCK = 2048
_CACHE_ENTRIES = 200_000
_CHUNK_CHARS = 1 << 20
_PIECES_AT_ONCE = 200_000

# The characters for which the quick pattern below decides as the
# vocabulary's own pattern does (ASCII, Latin letters, common punctuation).
_QUICK_TEXT = re.compile(
    "[\x00-\x84\x86-\x9f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ʯ‐-‧‰-⁞₠-₿]*"
)
_L, _N, _W = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ʯ", "0-9", "\t\n\x0b\x0c\r "
_QUICK = re.compile(
    f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_L}{_N}{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+"
)


class Vocabulary:
    """Ranks of a tiktoken file, and every pair of tokens that joins to a token."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.length = np.zeros(self.size, dtype=np.int64)
        for piece, rank in ranks.items():
            self.length[rank] = len(piece)
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), dtype=np.uint8)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        full = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.full = regex.compile(full)
        quick = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
        self.has_quick = pattern == quick
        self.pair: dict[int, int] = {}

    def for_merging(self) -> Vocabulary:
        """Builds the pairs, which only encoding needs."""
        if self.pair:
            return self
        pieces = [self.blob[a : a + n].tobytes() for a, n in zip(self.start.tolist(), self.length.tolist())]
        ranks = {piece: rank for rank, piece in enumerate(pieces) if piece}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    self.pair[left * self.size + right] = rank
        self._build_table()
        return self

    def _build_table(self) -> None:
        keys = np.fromiter(self.pair.keys(), dtype=np.int64, count=len(self.pair))
        values = np.fromiter(self.pair.values(), dtype=np.int64, count=len(self.pair))
        bits = max(4, int(8 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table_key = np.full(1 << bits, -1, dtype=np.int64)
        self.table_rank = np.zeros(1 << bits, dtype=np.int64)
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.table_key[at[left]] == -1
            _, first = np.unique(at[left[free]], return_index=True)
            put = left[free][first]
            self.table_key[at[put]], self.table_rank[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        """The rank of each pair, or ``none``."""
        keys = left * self.size + right
        at = self._slot(keys)
        found = self.table_key[at]
        out = np.where(found == keys, self.table_rank[at], none)
        rest = np.flatnonzero((found != keys) & (found != -1))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            found = self.table_key[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.table_rank[at[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return out

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each id's bytes end."""
        if len(ids) and int(ids.max()) >= self.size:
            raise ValueError("an id is not in the vocabulary")
        lengths = self.length[ids]
        if len(ids) and not lengths.all():
            raise ValueError("an id is not in the vocabulary")
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(self.start[ids] - ends + lengths, lengths) + np.arange(total)
        return self.blob[place], ends

    def split(self, text: str):
        """The pieces of a text, in order, as an iterator."""
        if self.has_quick and _QUICK_TEXT.fullmatch(text):
            return (m.group() for m in _QUICK.finditer(text)) if len(text) > _CHUNK_CHARS else iter(_QUICK.findall(text))
        return (m.group() for m in self.full.finditer(text))


def merge_many(vocabulary: Vocabulary, pieces: list[bytes], width: int) -> list[bytes]:
    """Packed ids of pieces of at most ``width`` bytes; width is a power of two.

    All matrices are held flat: a row's cells are consecutive.
    """
    out: list[bytes] = []
    none = vocabulary.size
    never = none * width
    bits = width.bit_length() - 1
    wide, full = width + 1, 2 * width
    place = np.arange(width)
    for start in range(0, len(pieces), _BLOCK):
        block = pieces[start : start + _BLOCK]
        n = len(block)
        lengths = np.fromiter(map(len, block), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in block]), dtype=np.uint8)
        grid = np.zeros((n, wide), dtype=np.int64)
        grid[:, :width] = vocabulary.byte_id[raw].reshape(n, width)
        alive = np.zeros((n, wide), dtype=bool)
        alive[:, :width] = place < lengths[:, None]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[np.arange(n), np.maximum(lengths - 1, 0)] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, full), never, dtype=np.int64)
        cells = np.flatnonzero((place + 1 < lengths[:, None]).ravel())
        at = cells & (width - 1)
        from_ = (cells >> bits) * wide + at
        ids, alive, after, before = grid.ravel(), alive.ravel(), after.ravel(), before.ravel()
        rank = vocabulary.ranks_of(ids[from_], ids[from_ + 1], none)
        flat = tree.ravel()
        flat[(cells >> bits) * full + width + at] = np.where(rank < none, (rank << bits) + at, never)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        live = np.flatnonzero(tree[:, 1] < never)
        while len(live):
            root = flat[live * full + 1]
            at, rank = root & (width - 1), root >> bits
            base, top = live * wide, live * full
            cell = base + at
            gone = after[cell]
            nxt = after[base + gone]
            ids[cell] = rank
            alive[base + gone] = False
            after[cell] = nxt
            before[base + nxt] = at
            prev = before[cell]
            # The pair to the right (the cell after the end holds no token) and the pair to the left.
            has_left = np.flatnonzero(prev >= 0)
            p_at = prev[has_left]
            lefts = np.concatenate([rank, ids[base[has_left] + p_at]])
            rights = np.concatenate([ids[base + nxt], rank[has_left]])
            made = vocabulary.ranks_of(lefts, rights, none)
            made[: len(live)][nxt == width] = none
            where = np.concatenate([at, p_at])
            tops = np.concatenate([top, top[has_left]])
            flat[tops + width + where] = np.where(made < none, (made << bits) + where, never)
            flat[top + width + gone] = never
            node = np.concatenate([where, gone]) + width
            tops = np.concatenate([tops, top])
            for _ in range(bits):
                node >>= 1
                child = tops + 2 * node
                flat[tops + node] = np.minimum(flat[child], flat[child + 1])
            live = live[flat[top + 1] < never]
        keep = alive.reshape(n, wide)
        packed = grid[keep].astype("<u4").tobytes()
        ends = np.cumsum(keep.sum(axis=1)) * 4
        begin = 0
        for end in ends.tolist():
            out.append(packed[begin:end])
            begin = end
    return out


def merge_one(vocabulary: Vocabulary, piece: bytes) -> bytes:
    """Packed ids of one piece of any length."""
    n = len(piece)
    ids = vocabulary.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
    pair, size = vocabulary.pair, vocabulary.size
    width = 1 << max(1, (n - 1).bit_length())
    none = size * width
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = pair.get(ids[i] * size + ids[i + 1])
        if rank is not None:
            tree[width + i] = rank * width + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                break
            tree[i] = least

    while tree[1] < none:
        rank, at = divmod(tree[1], width)
        gone = after[at]
        nxt = after[gone]
        ids[at], alive[gone], after[at] = rank, 0, nxt
        put(gone, none)
        mine = None
        if nxt < n:
            before[nxt] = at
            mine = pair.get(rank * size + ids[nxt])
        put(at, none if mine is None else mine * width + at)
        prev = before[at]
        if prev >= 0:
            theirs = pair.get(ids[prev] * size + rank)
            put(prev, none if theirs is None else theirs * width + prev)
    return np.array([x for x, a in zip(ids, alive) if a], dtype="<u4").tobytes()


class Encoder:
    """Encodes texts; keeps the ids of recent pieces, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary.for_merging()
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > _CACHE_ENTRIES:
            self.known = {}
        raw = [x.encode("utf-8", "surrogatepass") for x in new]
        # Pieces longer than every width come last, and are merged one by one.
        kinds = np.searchsorted(_WIDTHS, np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        for kind in range(len(_WIDTHS) + 1):
            those = np.flatnonzero(kinds == kind).tolist()
            own = [raw[i] for i in those]
            if kind < len(_WIDTHS) and len(those) > 8:
                ids = merge_many(self.vocabulary, own, _WIDTHS[kind])
            else:
                ids = [merge_one(self.vocabulary, x) for x in own]
            self.known.update(zip([new[i] for i in those], ids))

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece."""
        out = list(map(self.known.get, pieces))
        if None in out:
            missing = [i for i, x in enumerate(out) if x is None]
            new = [pieces[i] for i in missing]
            self._learn(list(dict.fromkeys(new)))
            for i, x in zip(missing, map(self.known.get, new)):
                out[i] = x
        return out

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        pieces, out = self.vocabulary.split(text), []
        while part := list(islice(pieces, _PIECES_AT_ONCE)):
            out.append(b"".join(self.of_pieces(part)))
        return b"".join(out)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """As encode() for each text; texts are taken together, up to a bound."""
        out: list[bytes] = []
        held: list[str] = []
        ends: list[int] = []
        chars = 0

        def flush() -> None:
            nonlocal held, ends, chars
            ids, begin = self.of_pieces(held), 0
            for end in ends:
                out.append(b"".join(ids[begin:end]))
                begin = end
            held, ends, chars = [], [], 0

        for text in texts:
            text = text or ""
            if len(text) > _CHUNK_CHARS // 4:
                flush()
                out.append(self.encode(text))
                continue
            held.extend(self.vocabulary.split(text))
            ends.append(len(held))
            chars += len(text)
            if chars > _CHUNK_CHARS:
                flush()
        flush()
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """This process's vocabulary of a file."""
    if (path, pattern) not in _vocabularies:
        _vocabularies[path, pattern] = Vocabulary(path, pattern)
    return _vocabularies[path, pattern]


def encoder(path: str, pattern: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(vocabulary(path, pattern))
    return _encoders[path, pattern]


at_end += [_encoders.clear, _vocabularies.clear]


_DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def decode_ids(vocabulary: Vocabulary, ids: bytes) -> bytes:
    """The bytes that packed ids stand for."""
    return vocabulary.bytes_of(np.frombuffer(ids, dtype="<u4"))[0].tobytes()


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids are packed as little-endian unsigned 32-bit integers."""
    ship(df.sparkSession)
    rows = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    @tidy
    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            texts = batch.column("text")
            for a, b in by_bytes(sizes_of(texts)):
                ids = own.encode_all(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "doc_id bigint, ids binary")


def _decoded(own: Vocabulary, ids: pa.Array, most: int):
    """Pieces of packed ids with their bytes: (first row, rows, ids, decoded)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(ids), 0), dtype=np.int64)
    for a, b in by_bytes(sizes.tolist()):
        part = ids.slice(a, b - a)
        packed = b"".join(x or b"" for x in part.to_pylist())
        text, ends = own.bytes_of(np.frombuffer(packed, dtype="<u4"))
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes[a:b]) // 4])]
        for c, d in by_bytes(np.diff(ends).tolist(), most):
            offsets = (ends[c : d + 1] - ends[c]).astype(np.int32)
            data = text[ends[c] : ends[d]].tobytes()
            yield a + c, d - c, part.slice(c, d - c), pa.Array.from_buffers(pa.binary(), d - c, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, ids, decoded): decoded is the bytes that the ids stand for."""
    ship(df.sparkSession)

    @tidy
    def run(batches):
        own = vocabulary(path, pattern)
        for batch in batches:
            for a, n, ids, decoded in _decoded(own, batch.column("ids"), 1 << 30):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, n), ids, decoded], schema=_DECODED)

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, decoded binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode()) by one worker for each task."""
    ship(df.sparkSession)
    rows = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))

    @tidy
    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            for a, b in by_bytes(sizes_of(batch.column("text"))):
                packed = pa.array(own.encode_all(batch.column("text").slice(a, b - a).to_pylist()), pa.binary())
                for c, n, ids, decoded in _decoded(own.vocabulary, packed, 1 << 30):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a + c, n), ids, decoded], schema=_DECODED)

    return rows.mapInArrow(run, "doc_id bigint, ids binary, decoded binary")
