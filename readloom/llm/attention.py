"""A causal self-attention model over subword ids, in numpy.

Ids are read in windows of two halves: the second half of each window is scored
with all of the first half in view, so that every id is scored once, under a
causal mask, from the ``HALF`` + 1 to 2 * ``HALF`` ids before it.

Each place has the embeddings of its id and of the id before it, to which the
heads of one attention layer add what they find at the places before (by content
and by distance). A softmax in two
steps predicts the next id: its class, then the id among the members of the
class. Each id has output weights of its own, so all of them are predicted from
the context, at the cost of about two square roots of the vocabulary.
"""

from __future__ import annotations

import math

import numpy as np

HALF = 16
HEADS, HEAD, WIDTH = 1, 8, 32
#: Places scored at once, and windows attended at once: bounds on memory.
_PLACES, _WINDOWS = 16_384, 64
_WIDER = 1.15
_NEVER = -1e4

_GAP = np.arange(HALF)[:, None] + HALF - np.arange(2 * HALF)[None, :]
_CAUSAL = _GAP >= 0
_GAP = np.clip(_GAP, 0, 2 * HALF - 1)


class Vocabulary:
    """Symbols of the model: ids seen in training by falling count, all other ids as one, and the end.

    The end also stands before the first id; a further symbol fills windows up.
    Classes are runs of symbols of the one order, so that members stand together.
    """

    def __init__(self, counts: dict[int, int], ends: int, size: int):
        seen = sorted((i for i, n in counts.items() if n > 0), key=lambda i: (-counts[i], i))
        self.size, self.used = size, len(seen)
        self.other, self.end, self.pad = self.used, self.used + 1, self.used + 2
        self.symbols = self.used + 2
        self.of_id = np.full(size + 1, self.other, dtype=np.int32)
        self.of_id[seen] = np.arange(self.used)
        self.of_id[size] = self.end
        self.log_other = -math.log(max(1, size - self.used))
        weight = np.array([counts[i] for i in seen] + [0.5, max(ends, 0.5)], dtype=np.float64)
        self.share = weight / weight.sum()
        # Rare symbols stand in larger classes: these are seldom opened.
        bounds, width = [0], float(max(4, math.isqrt(self.symbols) // 2))
        while bounds[-1] < self.symbols:
            bounds.append(min(self.symbols, bounds[-1] + int(width)))
            width *= _WIDER
        self.bounds = np.array(bounds, dtype=np.int64)
        self.classes = len(self.bounds) - 1
        self.class_of = np.repeat(np.arange(self.classes), np.diff(self.bounds))


def shapes(v: Vocabulary) -> list[tuple[str, tuple[int, ...]]]:
    inner = HEADS * HEAD
    return [
        ("E", (v.symbols + 1, WIDTH)), ("P", (v.symbols + 1, WIDTH)), ("Q", (WIDTH, inner)), ("K", (WIDTH, inner)), ("V", (WIDTH, inner)), ("D", (HEADS, 2 * HALF)),
        ("O", (inner, WIDTH)), ("C", (WIDTH, v.classes)), ("c", (v.classes,)), ("W", (v.symbols, WIDTH)), ("w", (v.symbols,)),
    ]


def start(v: Vocabulary, seed: int = 1) -> dict[str, np.ndarray]:
    """First weights: the shares of the corpus as biases, the rest drawn."""
    rng = np.random.default_rng(seed)
    scale = {"E": 0.3, "P": 0.1, "Q": 0.15, "K": 0.15, "V": 0.15, "O": 0.15, "C": 0.05, "W": 0.05}
    out = {k: (rng.normal(0, scale[k], shape) if k in scale else np.zeros(shape)).astype(np.float32) for k, shape in shapes(v)}
    mass = np.add.reduceat(v.share, v.bounds[:-1])
    out["c"][:] = np.log(mass)
    out["w"][:] = np.log(v.share / mass[v.class_of])
    return out


def windows(symbols: np.ndarray, text_ids: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Windows of many texts, and the symbol after each place of their second halves (-1 for none)."""
    n = np.asarray(text_ids, dtype=np.int64)
    rows = -(-n // HALF)
    first = np.cumsum(rows) - rows
    at = np.arange(len(symbols)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first * HALF, n)
    total = int(rows.sum())
    target = np.full(total * HALF, -1, dtype=np.int32)
    target[at] = symbols
    own = np.full(total * HALF + 1, v.pad, dtype=np.int32)
    own[at + 1] = symbols
    own = own[:-1].reshape(total, HALF)
    own[first[n > 0], 0] = v.end
    before = np.full_like(own, v.pad)
    before[1:] = own[:-1]
    before[first[n > 0]] = v.pad
    # A place behind the text's end predicts nothing; what it holds is never read.
    return np.hstack([before, own]), target.reshape(total, HALF)


class Model:
    """``pad`` is the filling symbol's row in E and P, which may hold a batch's symbols only."""

    def __init__(self, v: Vocabulary, weights: dict[str, np.ndarray], pad: int | None = None):
        self.v, self.w, self.pad = v, weights, v.pad if pad is None else pad
        self.careful = False  # set once scores have overflowed exp()

    def project(self) -> None:
        """Queries, keys and values of every symbol, and what the distance adds.

        One more cell in each head spares passes over the scores: it shuts out
        the filling symbol by its key, and sums the weights by the values.
        """
        e, n = self.w["E"], len(self.w["E"])

        def table(x: np.ndarray, last: float) -> np.ndarray:
            out = np.full((n, HEADS, HEAD + 1), last, dtype=np.float32)
            out[..., :HEAD] = x.reshape(n, HEADS, HEAD)
            return out

        self.q, self.k, self.val = table(e @ (self.w["Q"] / np.float32(math.sqrt(HEAD))), 1), table(e @ self.w["K"], 0), table(e @ self.w["V"], 1)
        self.k[self.pad, :, HEAD] = _NEVER
        self.bias = np.where(_CAUSAL, self.w["D"][:, _GAP], np.float32(_NEVER))

    def attend(self, rows: np.ndarray):
        """What the heads find for the places of the second halves, and the parts of it."""
        query, key, value = (_rows_of(x, own).transpose(0, 2, 1, 3) for x, own in ((self.q, rows[:, HALF:]), (self.k, rows), (self.val, rows)))
        # Many small products are faster with the keys laid out across.
        s = query @ np.ascontiguousarray(key.transpose(0, 1, 3, 2))
        s += self.bias
        raw = s if self.careful else None
        with np.errstate(over="ignore", invalid="ignore"):
            s = np.exp(s, out=None if self.careful else s)
            found = s @ value
        total = found[..., HEAD:]
        if not np.isfinite(total).all():
            if raw is None:
                self.careful = True
                return self.attend(rows)
            s = np.exp(raw - raw.max(axis=3, keepdims=True))
            found = s @ value
            total = found[..., HEAD:]
        # A place behind a text's end sees nothing; what it finds is never read.
        found = (found[..., :HEAD] / np.maximum(total, 1e-30)).transpose(0, 2, 1, 3).reshape(len(rows), HALF, HEADS * HEAD)
        return found, s, total, query, key, value

    def hidden(self, rows: np.ndarray) -> np.ndarray:
        """One row for each place of the second halves."""
        found = np.empty((len(rows), HALF, HEADS * HEAD), dtype=np.float32)
        for a in range(0, len(rows), _WINDOWS):
            found[a : a + _WINDOWS] = self.attend(rows[a : a + _WINDOWS])[0]
        out = found.reshape(-1, HEADS * HEAD) @ self.w["O"]
        out += _rows_of(self.w["E"], rows[:, HALF:].ravel())
        out += _rows_of(self.w["P"], rows[:, HALF - 1 : -1].ravel())
        return out

    def log_probability(self, symbols: np.ndarray, text_ids: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol after those before it in its text."""
        rows, target = windows(symbols, text_ids, self.v)
        out = np.empty(target.shape, dtype=np.float32)
        step = _PLACES // HALF
        for a in range(0, len(rows), step):
            own = target[a : a + step].ravel()
            known = np.flatnonzero(own >= 0)
            part = np.zeros(len(own), dtype=np.float32)
            self._log_of(self.hidden(rows[a : a + step]), known, own[known], part)
            out[a : a + step] = part.reshape(-1, HALF)
        flat = out.ravel()[target.ravel() >= 0]
        return flat + np.where(symbols == self.v.other, np.float32(self.v.log_other), np.float32(0))

    def _log_of(self, hidden: np.ndarray, places: np.ndarray, target: np.ndarray, out: np.ndarray) -> None:
        """Writes the natural log probabilities of the targets at their places."""
        v, w = self.v, self.w
        order, runs = self._by_class(target)
        places, target = places[order], target[order]
        h = _rows_of(hidden, places)
        log_p = _log_softmax(h, w["C"], w["c"], v.class_of[target])
        for c, i, j in runs:
            a, b = v.bounds[c], v.bounds[c + 1]
            log_p[i:j] += _log_softmax(h[i:j], w["W"][a:b].T, w["w"][a:b], target[i:j] - a)
        out[places] = log_p

    def _by_class(self, target: np.ndarray):
        """An order in which members of a class stand together, and (class, begin, end) of each run."""
        cls = self.v.class_of[target].astype(np.int16)
        order = np.argsort(cls, kind="stable")
        ends = np.cumsum(np.bincount(cls, minlength=self.v.classes)).tolist()
        return order, [(c, i, j) for c, (i, j) in enumerate(zip([0] + ends, ends)) if j > i]

    def gradients(self, rows: np.ndarray, target: np.ndarray, with_loss: bool = True) -> tuple[float, dict]:
        """Summed loss over the known places (0 if not asked for), and gradients of its mean."""
        w, v = self.w, self.v
        found, s, total, query, key, value = self.attend(rows)
        here = rows[:, HALF:]
        flat = target.ravel()
        known = np.flatnonzero(flat >= 0)
        n = np.float32(max(1, len(known)))
        order, runs = self._by_class(flat[known])
        known = known[order]
        t = flat[known]
        found_flat = found.reshape(-1, HEADS * HEAD)
        h = found_flat @ w["O"]
        h += _rows_of(w["E"], here.ravel())
        h += _rows_of(w["P"], rows[:, HALF - 1 : -1].ravel())
        h = _rows_of(h, known)
        p, loss = _error_of(h, w["C"], w["c"], v.class_of[t], n, with_loss)
        g = {"C": h.T @ p, "c": np.ones(len(p), dtype=p.dtype) @ p, "W": np.zeros_like(w["W"]), "w": np.zeros_like(w["w"])}
        dh = p @ w["C"].T
        for c, i, j in runs:
            a, b = v.bounds[c], v.bounds[c + 1]
            own = h[i:j]
            x, more = _error_of(own, w["W"][a:b].T, w["w"][a:b], t[i:j] - a, n, with_loss)
            loss += more
            g["W"][a:b], g["w"][a:b] = x.T @ own, np.ones(len(x), dtype=x.dtype) @ x
            dh[i:j] += x @ w["W"][a:b]
        d_h = np.zeros((here.size, WIDTH), dtype=dh.dtype)
        d_h[known] = dh
        g["O"] = found_flat.T @ d_h
        # The sum of weights times their gradients is what was found times its gradient;
        # the values' cell of ones takes it off in the same product.
        d_found = (d_h @ w["O"].T).reshape(*here.shape, HEADS, HEAD)
        off = -((d_found * found.reshape(d_found.shape)).reshape(-1, HEAD) @ np.ones(HEAD, dtype=dh.dtype))
        d_found = np.concatenate([d_found, off.reshape(*here.shape, HEADS, 1)], axis=3).transpose(0, 2, 1, 3) / np.maximum(total, 1e-30)
        d_s = d_found @ np.ascontiguousarray(value.transpose(0, 1, 3, 2))
        d_s *= s
        d_value = s.transpose(0, 1, 3, 2) @ d_found[..., :HEAD]
        by_gap = (np.ones(len(rows), dtype=d_s.dtype) @ d_s.reshape(len(rows), -1)).reshape(HEADS, -1)
        g["D"] = np.stack([np.bincount(_GAP.ravel(), weights=x, minlength=2 * HALF) for x in by_gap])
        back = lambda x: x.transpose(0, 2, 1, 3).reshape(-1, HEADS * HEAD)
        d_query = back(d_s @ key[..., :HEAD])
        d_query /= np.float32(math.sqrt(HEAD))
        d_key = d_s.transpose(0, 1, 3, 2) @ query[..., :HEAD]
        # By symbol first: a symbol's rows share their embedding.
        n_symbols = len(w["E"])
        inner = HEADS * HEAD
        sums = _sum_rows(rows.ravel(), [back(d_key), back(d_value)], n_symbols)
        # The id before a place stands at the place before, but for a window's first.
        later = np.zeros_like(d_h).reshape(*here.shape, WIDTH)
        later[:, :-1] = d_h.reshape(later.shape)[:, 1:]
        direct = _sum_rows(here.ravel(), [d_h, d_query, later.reshape(d_h.shape)], n_symbols)
        d_q = direct[:, WIDTH : WIDTH + inner]
        g["K"], g["V"], g["Q"] = w["E"].T @ sums[:, :inner], w["E"].T @ sums[:, inner:], w["E"].T @ d_q
        g["E"] = sums @ np.concatenate([w["K"], w["V"]], axis=1).T + d_q @ w["Q"].T + direct[:, :WIDTH]
        g["P"] = direct[:, WIDTH + inner :] + _sum_rows(rows[:, HALF - 1], [d_h.reshape(later.shape)[:, 0]], n_symbols)
        return loss, g


def _rows_of(table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """``table[index]``; the caller's indexes are within bounds."""
    return table.take(index, axis=0, mode="clip")


def _log_softmax(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each row's target among the columns."""
    x = h @ weights
    x += bias
    picked = x[np.arange(len(h)), target]
    with np.errstate(over="ignore"):
        total = np.exp(x, out=x) @ np.ones(x.shape[1], dtype=np.float32)
    if not (np.isfinite(total) & (total > 0)).all():
        x = h @ weights + bias
        top = x.max(axis=1)
        return picked - top - np.log(np.exp(x - top[:, None]).sum(axis=1))
    return picked - np.log(total)


def _error_of(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, target: np.ndarray, n, with_loss: bool) -> tuple[np.ndarray, float]:
    """Probabilities of the columns less 1 at the targets, divided by ``n``, and the summed loss."""
    x = h @ weights
    x += bias
    ones = np.ones(x.shape[1], dtype=x.dtype)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
        total = x @ ones
    if not (np.isfinite(total) & (total > 0)).all():
        x = h @ weights + bias
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        total = x @ ones
    at = np.arange(len(x))
    loss = -np.log(np.maximum(x[at, target] / total, 1e-30)).sum() if with_loss else 0
    x *= (1 / (total * n))[:, None]
    x[at, target] -= 1 / n
    return x, float(loss)


def _sum_rows(index: np.ndarray, values: list[np.ndarray], n: int) -> np.ndarray:
    """Sums of rows by index, of several tables side by side."""
    # Keys of 16 bits are sorted by their digits.
    order = np.argsort(index.astype(np.uint16) if n <= 1 << 16 else index, kind="stable")
    own = index[order]
    cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, dtype=np.int64)
    out = np.zeros((n, sum(x.shape[1] for x in values)), dtype=values[0].dtype)
    if len(cuts):
        at = 0
        for x in values:
            x = _rows_of(x, order)
            # Two numbers are added at a time where they make up a complex one.
            pairs = x.dtype == np.float32 and x.shape[1] % 2 == 0
            total = np.add.reduceat(x.view(np.complex64) if pairs else x, cuts, axis=0)
            out[own[cuts], at : at + x.shape[1]] = total.view(x.dtype) if pairs else total
            at += x.shape[1]
    return out


class Adam:
    """Adam; rows of embeddings without a gradient stay as they are."""

    def __init__(self, w: dict):
        self.w, self.t = w, 0
        self.m = {k: np.zeros_like(x) for k, x in w.items()}
        self.v = {k: np.zeros_like(x) for k, x in w.items()}

    def step(self, g: dict, rate: float, used: np.ndarray) -> None:
        """``used`` are the symbols that the rows of E's and P's gradients stand for."""
        self.t += 1
        rate *= math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            w, m, v, rows = self.w[k], self.m[k], self.v[k], None
            if k in ("E", "P", "W"):
                touched = np.abs(x) @ np.ones(x.shape[1], dtype=x.dtype) > 0
                if k != "W":
                    rows = used if touched.all() else used[touched]
                elif not touched.all():
                    rows = np.flatnonzero(touched)
                if not touched.all():
                    x = x[touched]
                if rows is not None:
                    m, v = _rows_of(m, rows), _rows_of(v, rows)
            m *= 0.9
            step = x * 0.1
            m += step
            v *= 0.99
            np.multiply(x, x, out=step)
            step *= 0.01
            v += step
            np.sqrt(v, out=step)
            step += 1e-8
            np.divide(m, step, out=step)
            step *= rate
            if rows is None:
                w -= step
            else:
                self.m[k][rows], self.v[k][rows] = m, v
                w[rows] -= step


def train(model: Model, rows: np.ndarray, target: np.ndarray, rate: float, seed: int) -> int:
    """Adam over the windows in an order drawn from the seed, with a falling rate; gives the ids seen."""
    order = np.random.default_rng(seed).permutation(len(rows))
    # About 500 steps or more, as far as steps of 64 windows make so many.
    batch = min(512, max(64, len(rows) // 500))
    best, steps = Adam(model.w), -(-len(rows) // batch)
    place = np.zeros(model.v.symbols + 1, dtype=np.intp)
    for i in range(steps):
        own = order[i * batch : (i + 1) * batch]
        # The other symbols have no gradient in E and P, and nothing reads their projections.
        batch_rows = rows[own]
        used = np.flatnonzero(np.bincount(np.append(batch_rows.ravel(), model.v.pad), minlength=model.v.symbols + 1))
        place[used] = np.arange(len(used))
        part = Model(model.v, model.w | {k: _rows_of(model.w[k], used) for k in ("E", "P")}, int(place[model.v.pad]))
        part.project()
        best.step(part.gradients(_rows_of(place, batch_rows), target[own], with_loss=False)[1], rate * min(1.0, (i + 1) / 20) * (1 - 0.9 * i / steps), used)
    return int((target >= 0).sum())
