"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A text's probability is the sum over all ways to cut it into pieces, computed
by the forward algorithm. Pieces do not cross white space, so the sum factors
over lower-cased words; a word's forward scores are computed once and kept, up to a bound.
Words of any length are summed whole: long ones go through the same sum with a
window of the last places in place of all.
Piece probabilities come from expectation maximisation over the same sums
(forward-backward), on a sample of labelled rows.

The fit is the one thing that reads a sample: about ``per_language`` labelled
rows of each language, drawn by a hash of the id among texts of at most
``most_chars`` characters; there, words over ``_PART`` characters are cut.
Predictions read whole texts and whole words.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if no labelled row can be learnt from; characters that no
piece has are scored alike in all languages; ties go to the language that
sorts first; repeated rows get repeated results; an empty table gives no rows.
Columns of ``predict`` stand behind all columns of the documents; of those,
columns named ``lid_lang`` or ``lid_score`` make way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.arrow import add_columns

_MARK = "▁"
_BLOCK = 4096
_KEPT_WORDS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FLOOR = 1e-9


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; the id null counts as empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def public_pieces(path: str) -> list[str]:
    """The vocabulary's text pieces, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return sorted(set(map(model.id_to_piece, plain)))


class Lattice:
    """Finds the vocabulary's pieces in words, many words at a time."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        if len(pieces) > 1 and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have the same hash")
        bits = 18
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, dtype=bool)
        self.filter[(self.hashes >> self.shift).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF
        return h

    def edges(self, words: list[str]):
        """Codes of words of one length, and (start, end) -> (rows, piece ids)."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), n).astype(np.uint64)
        found = {}
        for start in range(n):
            h = np.zeros(len(words), dtype=np.uint64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                h = (h + codes[:, end - 1] + np.uint64(1)) * _BASE
                rows, ids = self.lookup(h)
                if len(rows):
                    found[start, end] = rows, ids
        return n, found

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a flat array of hashes has a piece's, and the pieces' ids."""
        rows = np.flatnonzero(self.filter[(h >> self.shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[rows]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[rows]
        return rows[hit], self.ids[at[hit]]


def forward(n: int, found: dict, n_rows: int, p: np.ndarray, longest: int) -> np.ndarray:
    """alpha[i] = probability of the first i characters; rows x languages each.

    Each position is rescaled by a fixed factor, so that long words do not
    underflow; short_scores() takes the factor out again.
    """
    alpha = np.zeros((n + 1, n_rows, p.shape[1]))
    alpha[0] = 1.0
    for end in range(1, n + 1):
        alpha[end] = alpha[end - 1] * (_FLOOR * _SCALE)
        for start in range(max(0, end - longest), end):
            if (start, end) in found:
                rows, ids = found[start, end]
                alpha[end][rows] += alpha[start][rows] * (p[ids] * _SCALE ** (end - start))
    return alpha


_SCALE = 16.0
_PART = 48
_CELLS = 1 << 21


def _by_length(words: list[str]):
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for those in groups.values():
        for k in range(0, len(those), _BLOCK):
            yield those[k : k + _BLOCK]


def cut(word: str) -> list[str]:
    """A marked word in parts of bounded length, for the fit; nearly all words are one part."""
    marked = _MARK + word
    return [marked[i : i + _PART] for i in range(0, len(marked), _PART)]


def short_scores(lattice: Lattice, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural log probabilities, words x languages, summed over segmentations."""
    out = np.zeros((len(words), p.shape[1]))
    for those in _by_length(words):
        n, found = lattice.edges([words[i] for i in those])
        out[those] = np.log(np.maximum(forward(n, found, len(those), p, lattice.longest)[n], 1e-300)) - n * np.log(_SCALE)
    return out


def long_scores(lattice: Lattice, p: np.ndarray, words: list[str]) -> np.ndarray:
    """The same for words of any length: only the last places' sums are held, rescaled as they go."""
    out = np.zeros((len(words), p.shape[1]))
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    while order:
        rows = max(1, min(len(order), _BLOCK, _CELLS // len(words[order[0]])))
        those, order = order[:rows], order[rows:]
        sizes = np.array([len(words[i]) for i in those])
        codes = np.zeros((rows, sizes[0]), dtype=np.uint32)
        for r, i in enumerate(those):
            codes[r, : sizes[r]] = np.frombuffer(words[i].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        # Row j: the hash of the last j + 1 characters, and the sum up to where they begin.
        h = np.zeros((lattice.longest, rows), dtype=np.uint64)
        alpha = np.zeros((lattice.longest, rows, p.shape[1]))
        alpha[0] = 1.0
        log_scale = np.zeros((rows, p.shape[1]))
        alive = rows
        for end in range(1, int(sizes[0]) + 1):
            h[1:] = h[:-1]
            h[0] = 0
            h += codes[:, end - 1].astype(np.uint64) + np.uint64(1)
            h *= _BASE
            now = alpha[0] * _FLOOR
            at, ids = lattice.lookup(h[:, :alive].ravel())
            back, row = at // alive, at % alive
            np.add.at(now, row, alpha[back, row] * p[ids])
            for r in range(alive - 1, -1, -1):
                if sizes[r] > end:
                    break
                out[those[r]] = np.log(now[r]) + log_scale[r]
                alive = r
            alpha[1:] = alpha[:-1]
            alpha[0] = now
            if end % 8 == 0:
                top = alpha.max(axis=0)
                alpha /= top
                log_scale += np.log(top)
    return out


def word_scores(lattice: Lattice, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Of marked words, short and long."""
    out = np.zeros((len(words), p.shape[1]))
    sizes = np.array([len(w) for w in words])
    for those, scores in ((np.flatnonzero(sizes <= _PART), short_scores), (np.flatnonzero(sizes > _PART), long_scores)):
        if len(those):
            out[those] = scores(lattice, p, [words[i] for i in those.tolist()])
    return out


def fit(lattice: Lattice, counts: dict[str, dict[str, int]], rounds: int = 4, add: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities as pieces x languages."""
    languages = sorted(counts)
    p = np.zeros((len(lattice.pieces), len(languages)))
    for k, language in enumerate(languages):
        weight: dict[str, int] = {}
        for word, n in counts[language].items():
            for part in cut(word):
                weight[part] = weight.get(part, 0) + n
        parts = list(weight)
        groups = [(those, *lattice.edges([parts[i] for i in those])) for those in _by_length(parts)]
        lengths = np.array([len(x) for x in lattice.pieces], dtype=float)
        q = np.full((len(lattice.pieces), 1), 1.0)
        q[:, 0] = 0.03 ** np.minimum(lengths, 4)
        for _ in range(rounds):
            expected = np.zeros(len(lattice.pieces))
            for those, n, found in groups:
                w = np.array([weight[parts[i]] for i in those], dtype=float)
                alpha = forward(n, found, len(those), q, lattice.longest)[:, :, 0]
                beta = np.zeros_like(alpha)
                beta[n] = 1.0
                for start in range(n - 1, -1, -1):
                    beta[start] = beta[start + 1] * (_FLOOR * _SCALE)
                    for end in range(start + 1, min(n, start + lattice.longest) + 1):
                        if (start, end) in found:
                            rows, ids = found[start, end]
                            beta[start][rows] += q[ids, 0] * _SCALE ** (end - start) * beta[end][rows]
                total = np.maximum(alpha[n], 1e-300)
                for (start, end), (rows, ids) in found.items():
                    share = alpha[start][rows] * q[ids, 0] * _SCALE ** (end - start) * beta[end][rows] / total[rows] * w[rows]
                    expected += np.bincount(ids, weights=share, minlength=len(expected))
            q[:, 0] = expected / max(expected.sum(), 1e-300)
        p[:, k] = expected
    shared = p.sum(axis=1) / max(p.sum(), 1e-300)
    p = (p + add * shared[:, None] * len(languages) + 1e-6) / (p.sum(axis=0) + add * len(languages) + 1e-6 * len(p))
    return languages, p


class Model:
    """Scores whole texts; keeps word scores, up to a bound."""

    def __init__(self, lattice: Lattice, languages: list[str], p: np.ndarray):
        import regex

        self.lattice, self.languages, self.p = lattice, languages, p
        self.letter = regex.compile(r"\p{L}")
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1024, len(languages)))

    def _learn(self, words: list[str]) -> None:
        scores = word_scores(self.lattice, self.p, [_MARK + w for w in words])
        if len(self.place) + len(words) > _KEPT_WORDS:
            self.place = {}
        base = len(self.place)
        if base + len(words) > len(self.scores):
            grown = np.zeros((2 * (base + len(words)), len(self.languages)))
            grown[:base] = self.scores[:base]
            self.scores = grown
        self.scores[base : base + len(words)] = scores
        self.place.update(zip(words, range(base, base + len(words))))

    def of_texts(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        if isinstance(split, pa.ChunkedArray):
            split = split.combine_chunks()
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        known = list(map(self.place.get, distinct))
        if None in known:
            new = [w for w, k in zip(distinct, known) if k is None]
            before = self.place
            self._learn(new)
            known = list(map(self.place.get, distinct))
            if before is not self.place and None in known:
                self._learn([w for w, k in zip(distinct, known) if k is None])
                known = list(map(self.place.get, distinct))
        at = np.array(known, dtype=np.int64)[np.asarray(words.indices, dtype=np.int64)] if distinct else np.zeros(0, dtype=np.int64)
        n = np.asarray(pc.list_value_length(split), dtype=np.int64)
        total = np.zeros((len(n), len(self.languages)))
        full = np.flatnonzero(n)
        if len(full):
            starts = (np.cumsum(n) - n)[full]
            total[full] = np.add.reduceat(self.scores[at], starts, axis=0)
        best = total.argmax(axis=1)
        share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        lang, score = [], []
        for text, k, s in zip(texts, best.tolist(), share.tolist()):
            letter = text.is_valid and self.letter.search(text.as_py()) is not None
            lang.append(self.languages[k] if letter else "und")
            score.append(s if letter else 0.0)
        return lang, score


def count_words(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, most_chars: int) -> dict[str, dict[str, int]]:
    """Word counts of each language, of a sample of labelled rows."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, float(per_language) / n)])
    chosen = labelled.where((draw < F.element_at(share, F.col(lang_col))) & (F.length(text_col) <= most_chars))
    words = chosen.select(F.col(lang_col).alias("lang"), F.explode(F.split(F.lower(text_col), r"\s+")).alias("word")).where(F.length("word") > 0)
    out: dict[str, dict[str, int]] = {}
    for r in words.groupBy("lang", "word").count().toLocalIterator():
        out.setdefault(r["lang"], {})[r["word"]] = r["count"]
    return out


def train(
    labelled: DataFrame,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 400,
    most_chars: int = 20_000,
) -> tuple[list[str], list[str], np.ndarray]:
    """(pieces, languages, probabilities) learnt from labelled rows."""
    pieces = public_pieces(vocabulary_path)
    counts = count_words(labelled, id_col, text_col, lang_col, per_language, most_chars)
    present = {c for words in counts.values() for w in words for c in w} | {_MARK}
    pieces = sorted({p for p in pieces if set(p) <= present} | present)
    if not counts:
        return pieces, [], np.zeros((len(pieces), 0))
    languages, p = fit(Lattice(pieces), counts)
    return pieces, languages, p


def predict(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """The documents with ``lid_lang`` and ``lid_score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        pieces, languages, p = sent.value
        own = Model(Lattice(pieces), languages, p) if languages else None

        def work(batch):
            texts = batch.column(text_col)
            lang, score = own.of_texts(texts) if own else (["und"] * len(texts), [0.0] * len(texts))
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

        return work

    return add_columns(docs, "lid_lang string, lid_score double", text_col, make)
