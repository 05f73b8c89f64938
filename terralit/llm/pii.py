"""Personal data by a character-level bidirectional LSTM with CRF transitions, in numpy (operator 10)."""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import ready, unused

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "IBAN", "SSN")
LABELS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
HIDDEN, WINDOW, STRIDE, LANES = 16, 512, 448, 512
STEPS, BATCH, LENGTH, SEED = 1600, 20, 256, 7
#: No kind has a shorter form: the least address is a@b.c.
LEAST = 5

_PUNCT = "@.,:;-_+()[]{}<>/\\\"'=#%&*!?|$~^`"
GROUPS = 10 + len(_PUNCT)
#: Symbols: the groups below, then each ASCII letter, as the names before secrets are words.
CLASSES = GROUPS + 52
_TABLE = np.full(0x250, 9, np.int64)
for _i in range(0x250):
    _c = chr(_i)
    _TABLE[_i] = (1 if _c.isdigit() else 2 if _c in "abcdef" else 3 if "a" <= _c <= "z" else 4 if _c in "ABCDEF" else 5 if "A" <= _c <= "Z"
                  else 6 if _c == " " or _c == "\t" else 7 if _c in "\r\n" else 10 + _PUNCT.index(_c) if _c in _PUNCT else 8 if _c.isalpha() else 9)
#: The group of each symbol; a letter begins training with the weights of its group.
_GROUP = np.arange(CLASSES)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"):
    _GROUP[GROUPS + _i] = _TABLE[ord(_c)]
    _TABLE[ord(_c)] = GROUPS + _i


def classes(text: str) -> np.ndarray:
    """The input symbol of each character, 1 to CLASSES - 1; 0 pads."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.minimum(code, 0x24F)]


# --- labelled spans for training --------------------------------------------------------

class Dice(random.Random):
    """random.Random with integers() as numpy's generators have it; far faster for single draws."""

    def integers(self, low, high=None, size=None):
        low, high = (0, low) if high is None else (low, high)
        if size is None:
            return low + int(self.random() * (high - low))
        return [low + int(self.random() * (high - low)) for _ in range(size)]


_PARTS = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "ou", "é", "è", "ñ", "ó", "ê", "ç", "í", "á",
          "ä", "ö", "ü", "ß", "ç", "ch", "ung", "que", "ción", "ment", "ll", "qu", "br", "ka", "zo", "my", "wi", "be", "up", "ja", "fl", "sch", "ver", "pf", "keit", "lich", "heit",
          "ein", "die", "und", "ge", "ng", "sh", "wh", "bl", "str", "tion", "ly", "ing", "tt", "ar", "os", "is", "eau", "eux", "elle", "mente", "ado", "able")


class Speech(Dice):
    """Dice with the syllables of one made-up language: some of the usual ones, some of its own."""

    def __init__(self, seed: int):
        super().__init__(seed)
        own = ["".join(_from(self, s, self.integers(1, 3)) for s in self.sample(("bcdfghjklmnpqrstvwxyz", "aeiouáéíóúäöüàèêôåøõ", "nrstlmñçßšžčł"), 2)) for _ in range(self.integers(4, 16))]
        self.parts = self.sample(_PARTS, self.integers(8, 40)) + own


def _word(r: Speech) -> str:
    return "".join(r.parts[k] for k in r.integers(0, len(r.parts), r.integers(1, 5)))


def _long(r: Speech) -> str:
    """A longer word of prose, as it isn't a secret unless a name says so."""
    return "".join(r.parts[k] for k in r.integers(0, len(r.parts), r.integers(3, 10)))


def _digits(r, n: int) -> str:
    return "".join(str(k) for k in r.integers(0, 10, n))


def _from(r, letters: str, n: int) -> str:
    return "".join(letters[k] for k in r.integers(0, len(letters), n))


def _plain(r) -> str:
    """A word of prose, markup, numbers or other text that isn't personal."""
    w, k = _long(r) if r.integers(3) == 0 else _word(r), r.integers(0, 40)
    if k < 24:
        return w if k > 3 else w.capitalize()
    if k < 30:
        return w + (".", ",", "!!", "%%%", "&&&", "***", "$$$", "###", ";", ":", " |", "?")[r.integers(0, 12)]
    if k < 32:
        return w.upper() + ("!!" if k == 31 else "")
    if k == 32:
        return ("version ", "Version ", "CC BY-NC ", "v", "GPL-", "Apache-")[r.integers(0, 6)] + _digits(r, 1) + ("." + _digits(r, 1)) * r.integers(0, 3)
    if k == 33:
        return _digits(r, r.integers(1, 8))
    if k == 34:
        return ("%d-%02d-%02d" % (r.integers(1900, 2100), r.integers(1, 13), r.integers(1, 29))) if r.integers(2) else "%02d:%02d" % (r.integers(24), r.integers(60))
    if k == 35:
        return ("$", "€", "", "")[r.integers(0, 4)] + _digits(r, r.integers(1, 4)) + (".", ",")[r.integers(2)] + _digits(r, r.integers(1, 4)) + ("%", "", " km", "°C")[r.integers(0, 4)]
    if k == 36:
        return f"{_word(r)}{('=', ' = ', ': ')[r.integers(3)]}{_word(r)}"
    if k == 37:
        return f"http://{_word(r)}.example.com/{_word(r)}/{_digits(r, r.integers(1, 5))}"
    if k == 38:
        return f"({_digits(r, r.integers(1, 4))})" if r.integers(2) else "@" + w
    return f"{w}-{_digits(r, 2)}" if r.integers(2) else "\n"


def _personal(r) -> tuple[str, str, str, str]:
    """(kind, what stands before, the span, what stands after)."""
    k = KINDS[r.integers(0, len(KINDS))]
    if k == "EMAIL":
        user = _word(r) + ("", "." + _digits(r, r.integers(1, 4)), "_" + _word(r), "." + _word(r), _digits(r, 2), "-" + _word(r), "+" + _word(r))[r.integers(0, 7)]
        host = _word(r) + ("", _digits(r, r.integers(1, 3)))[r.integers(2)] + ("", "." + _word(r), ".example")[r.integers(0, 3)]
        return k, "", f"{user}@{host}.{('com', 'org', 'net', 'de', 'co.uk', 'io')[r.integers(0, 6)]}", ""
    if k == "PHONE":
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        return k, "", (f"+1 ({a}) {b}-{c}", f"+1 ({a}) 555-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{_digits(r, 2)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+1 {a} {b} {c}")[r.integers(0, 8)], ""
    if k == "IBAN":
        d = ("DE", "FR", "ES", "GB", "IT", "NL", "AT")[r.integers(0, 7)] + _digits(r, 2) + ("", _from(r, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4))[r.integers(3) == 0]
        d += _digits(r, r.integers(14, 23) - len(d) + 4)
        return k, "", " ".join(d[i:i + 4] for i in range(0, len(d), 4)) if r.integers(2) else d, ""
    if k == "SSN":
        return k, ("", "", "SSN ", "SSN: ")[r.integers(0, 4)], f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", ""
    if k == "IP":
        return k, "", ".".join(str(r.integers(0, 256 if r.integers(5) else 12)) for _ in range(4)), ""
    if k == "CARD":
        d = _digits(r, 16)
        sep = ("", "", "", " ", "-")[r.integers(0, 5)]
        return k, "", sep.join(d[i:i + 4] for i in range(0, 16, 4)), ""
    name = ("token", "password", "api_key", "secret", "key", "passwd", "pwd", "auth", "access_token")[r.integers(0, 9)]
    form = r.integers(0, 9)
    if form >= 6:  # without any digit
        before = f"{name}{(': ', '=', ' = ')[r.integers(3)]}" + ("", '"')[r.integers(4) == 0]
        if form == 6:
            span = "".join(_word(r) for _ in range(r.integers(3, 7)))
            span = span if len(span) >= 10 else span + _from(r, "abcdefghijklmnopqrstuvwxyz", 8)
        else:
            span = ("sk-", "ghp_", "", "")[r.integers(4)] + _from(r, ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")[r.integers(2)], r.integers(14, 41))
            before = "" if form == 8 and r.integers(3) == 0 and len(span) >= 24 and sum(c.isupper() for c in span) > 5 else before
        return k, before, span, '"' if before.endswith('"') else ""
    if form == 0:
        return k, "", "AKIA" + _from(r, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), ""
    hexes = _from(r, "0123456789abcdef", (18, 20, 24, 32, 40, 40, 64)[r.integers(0, 7)])
    if form == 1:
        return k, f'{name} = "', hexes, '"'
    if form == 2:
        return k, f"{name}=", hexes, ""
    if form == 3:
        return k, f"{name}=", _from(r, "0123456789abcdef", 18), ""
    if form == 4:
        return k, f"{name}{(': ', '=', ' = ')[r.integers(3)]}", ("sk-", "ghp_", "")[r.integers(3)] + _from(r, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r.integers(20, 40)), ""
    return k, "", hexes, ""


def labelled(r: Dice, words: int = 40) -> tuple[str, list[tuple[int, int, str]]]:
    """A made-up text and its labelled spans (start, end, kind): one in ten of all words is personal, or one
    in fifty, or none."""
    text, spans = "", []
    r, share = Speech(r.integers(1 << 48)), (0.0, 0.02, 0.1, 0.1)[r.integers(4)]
    for i in range(words):
        glue = "" if not text or text.endswith("\n") else "\n" if r.random() < 0.04 else " "
        if r.random() < share:
            kind, before, span, after = _personal(r)
            at = len(text) + len(glue) + len(before)
            spans.append((at, at + len(span), kind))
            text += glue + before + span + after + (".", ",", "")[min(2, r.integers(0, 12))]
        else:
            text += glue + _plain(r)
    return text, spans


def tags(text: str, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(len(text), np.int64)
    for a, b, k in spans:
        n = 1 + 2 * KINDS.index(k)
        y[a:b] = n + 1
        y[a] = n
    return y


# --- the model --------------------------------------------------------------------------

def _soft(x):
    """x / (1 + |x|), which stands for tanh in all gates and states: a tenth of its time in numpy."""
    return x / (1 + np.abs(x))


def _sig(x):
    return 0.5 * _soft(x) + 0.5


def _init(r) -> dict[str, np.ndarray]:
    p = {"t": np.zeros((LABELS, LABELS)), "t0": np.zeros(LABELS), "bo": np.zeros(LABELS), "wo": r.normal(0, 0.2, (2 * HIDDEN, LABELS))}
    for d in "fb":
        p["x" + d] = r.normal(0, 0.3, (CLASSES, 4 * HIDDEN))[_GROUP] + r.normal(0, 0.03, (CLASSES, 4 * HIDDEN))
        p["x" + d][:, HIDDEN:2 * HIDDEN] += 3  # the forget gate's bias
        p["h" + d] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _both(p, x, keep=None):
    """Hidden states (T, N, 2H) of symbols x (T, N): forward and, over the reversed text, backward, in
    one loop over stacked arrays."""
    wx, wh = np.stack((p["xf"], p["xb"])), np.stack((p["hf"], p["hb"]))
    T, n, H = len(x), x.shape[1], HIDDEN
    sym = np.stack((x, x[::-1]), 1)
    side = np.arange(2)[:, None]
    h = np.zeros((2, n, H), np.float32)
    c = np.zeros_like(h)
    out = np.empty((T, 2, n, H), np.float32)
    if keep is not None:
        for k, width in (("h", H), ("c", H), ("s", 3 * H), ("z", H), ("tc", H)):
            keep[k] = np.empty((T, 2, n, width), np.float32)
    for t in range(T):
        g = wx[side, sym[t]] + h @ wh
        s, z = _sig(g[..., :3 * H]), _soft(g[..., 3 * H:])
        if keep is not None:
            keep["h"][t], keep["c"][t], keep["s"][t], keep["z"][t] = h, c, s, z
        c = s[..., H:2 * H] * c + s[..., :H] * z
        tc = _soft(c)
        if keep is not None:
            keep["tc"][t] = tc
        h = s[..., 2 * H:] * tc
        out[t] = h
    return np.concatenate((out[:, 0], out[::-1, 1]), 2)


def _both_back(p, x, dboth, keep, g):
    """Gradients of the two LSTMs from that of their hidden states (T, N, 2H), added to g."""
    T, n, H = len(x), x.shape[1], HIDDEN
    wt = np.stack((p["hf"].T, p["hb"].T))
    dout = np.stack((dboth[:, :, :H], dboth[::-1, :, H:]), 1)
    dgs = np.empty((T, 2, n, 4 * H), np.float32)
    dh = np.zeros((2, n, H), np.float32)
    dc = np.zeros_like(dh)
    s, z, tc, before = keep["s"], keep["z"], keep["tc"], keep["c"]
    slope, rise, bend = 0.5 * (1 - np.abs(2 * s - 1)) ** 2, (1 - np.abs(z)) ** 2, (1 - np.abs(tc)) ** 2
    for t in range(T - 1, -1, -1):
        dh = dh + dout[t]
        dc = dc + dh * s[t, ..., 2 * H:] * bend[t]
        d = dgs[t]
        d[..., :H], d[..., H:2 * H], d[..., 2 * H:3 * H] = dc * z[t], dc * before[t], dh * tc[t]
        d[..., :3 * H] *= slope[t]
        d[..., 3 * H:] = dc * s[t, ..., :H] * rise[t]
        dh = d @ wt
        dc = dc * s[t, ..., H:2 * H]
    for k, (name, sym) in enumerate((("f", x), ("b", x[::-1]))):
        flat = dgs[:, k].reshape(-1, 4 * H)
        one = np.zeros((CLASSES, len(flat)), np.float32)
        one[sym.reshape(-1), np.arange(len(flat))] = 1
        g["x" + name], g["h" + name] = one @ flat, keep["h"][:, k].reshape(-1, H).T @ flat


def emissions(p, x):
    """(T, N, LABELS) scores of symbols x (T, N)."""
    return _both(p, x) @ p["wo"] + p["bo"]


def _gradient(p, x, y):
    """Mean negative log-likelihood of the CRF and its gradient; x, y are (T, N).  The forward and backward
    sums are kept as probabilities, scaled at each position."""
    T, n = x.shape
    kept: dict[str, np.ndarray] = {}
    both = _both(p, x, kept)
    e = (both @ p["wo"] + p["bo"]).astype(np.float64)
    m = np.exp(p["t"].astype(np.float64))
    top = e.max(2, keepdims=True)
    w = np.exp(e - top)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((T, n, 1))
    a = w[0] * np.exp(p["t0"].astype(np.float64))
    for k in range(T):
        if k:
            a = (a @ m) * w[k]
        scale[k] = a.sum(1, keepdims=True)
        a = a / scale[k]
        alpha[k] = a
    for k in range(T - 2, -1, -1):
        beta[k] = ((w[k + 1] * beta[k + 1]) @ m.T) / scale[k + 1]
    z = (np.log(scale) + top).sum(0)[:, 0]
    de = alpha * beta
    dt = m * np.einsum("tni,tnj->ij", alpha[:-1], w[1:] * beta[1:] / scale[1:])
    rows, cols = np.arange(T)[:, None], np.arange(n)
    gold = p["t0"][y[0]] + e[rows, cols, y].sum(0) + p["t"][y[:-1], y[1:]].sum(0)
    de[rows, cols, y] -= 1
    np.add.at(dt, (y[:-1].reshape(-1), y[1:].reshape(-1)), -1)
    de = (de / n).astype(np.float32)
    g = {"t": (dt / n).astype(np.float32), "t0": de[0].sum(0),
         "wo": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, LABELS), "bo": de.sum((0, 1))}
    _both_back(p, x, de @ p["wo"].T, kept, g)
    return float((z - gold).mean()), g


@functools.lru_cache(maxsize=2)
def _trained(steps: int, seed: int):
    r = Dice(seed)
    p = _init(np.random.default_rng(seed))
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    text, spans = "", []
    for step in range(1, steps + 1):
        xs, ys = [], []
        while len(xs) < BATCH:
            text, spans = labelled(r)
            c, y = classes(text), tags(text, spans)
            for at in range(int(r.integers(0, LENGTH)), len(c) - LENGTH, LENGTH):
                y_ = y[at:at + LENGTH].copy()
                if y_[0] and y_[0] % 2 == 0:
                    y_[0] -= 1  # a span that the window cuts begins with it
                xs.append(c[at:at + LENGTH]), ys.append(y_)
        x, y = np.array(xs[:BATCH]).T, np.array(ys[:BATCH]).T
        _, g = _gradient(p, x, y)
        norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
        rate = 0.02 * min(1, step / 30) * (1 - step / (steps + 1)) ** 0.7
        for k in p:
            w = g[k] * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * w
            v[k] = 0.99 * v[k] + 0.01 * w * w
            p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)
    return p


def trained(steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The model, trained by Adam on the CRF likelihood of labelled(); the same for the same arguments."""
    return _trained(steps, seed)


def _live(sizes: np.ndarray, t: int) -> int:
    """How many of the lanes, longest first, have a position t."""
    return int(np.searchsorted(-sizes, -t, side="left"))


def scores(p, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Emissions (T, LABELS - 1, N) of the lanes x (T, N), longest first: of each B, then of each I, less that of O.
    A lane takes part as long as it has characters, so nothing of the others and no padding gets into
    its states.  Training leaves float64 weights; all is multiplied in float32, as mixed types make numpy convert
    the states at each step."""
    H, (T, n) = HIDDEN, x.shape
    p = {k: w.astype(np.float32, copy=False) for k, w in p.items()}
    out = np.zeros((T, LABELS - 1, n), np.float32)
    live = [_live(sizes, t) for t in range(T)]
    one, half = np.float32(1), np.float32(0.5)
    g, u = np.zeros((4, n, H), np.float32), np.zeros((4, n, H), np.float32)  # a block for each gate
    a = np.empty((n, H), np.float32)
    by_gate = lambda w: np.ascontiguousarray(w.reshape(len(w), 4, H).transpose(1, 0, 2))
    for d, order, wo in (("f", range(T), p["wo"][:H]), ("b", range(T - 1, -1, -1), p["wo"][H:])):
        w, v = by_gate(p["x" + d]), by_gate(p["h" + d] * half)
        wo = np.ascontiguousarray(((wo - wo[:, :1]) * half)[:, _ORDER].T)  # h is kept doubled
        h, c = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
        for t in order:
            m = live[t]
            G, U, A, C = g[:, :m], u[:, :m], a[:m], c[:m]
            at = x[t, :m]
            np.matmul(h[:m], v, out=G)
            for k in range(4):
                w[k].take(at, 0, U[k], "clip")
            G += U
            np.abs(G, out=U)
            U += one
            G /= U
            G[:3] += one  # twice the gate
            np.multiply(G[0], G[3], out=A)
            C *= G[1]
            C += A
            C *= half
            np.abs(C, out=A)
            A += one
            np.divide(C, A, out=A)
            np.multiply(G[2], A, out=h[:m])
            out[t, :, :m] += wo @ h[:m].T
    out += (p["bo"] - p["bo"][0])[_ORDER][:, None]
    return out


#: The labels in the order of scores(): each B, then each I.
_ORDER = np.r_[1:LABELS:2, 2:LABELS:2]


def doubtful(e: np.ndarray, sizes: np.ndarray, t: np.ndarray, t0: np.ndarray) -> np.ndarray:
    """The lanes whose best path may leave O.  In the others no run of other labels can gain anything: runs of one kind
    count exactly, and changes of kind within a run with the best of such transitions, so none is missed."""
    o, B, n = t[0, 0], len(KINDS), e.shape[2]
    w = t[np.ix_(_ORDER, _ORDER)] - o
    leave, first = t[_ORDER, 0] - o, t0[_ORDER] - t0[0]
    k = np.arange(B)
    wide = lambda v: np.ascontiguousarray(np.broadcast_to(v.astype(np.float32)[:, None], (len(v), n)))
    enter, begun, on = wide(t[0, _ORDER] - o), wide(w[k, B + k]), wide(w[B + k, B + k])
    w[k, B + k] = w[B + k, B + k] = -np.inf
    change = wide(w.max(0))
    f = first[:, None] + e[0]
    best = f.copy()
    last = np.full(n, -np.inf, np.float32)
    last[sizes == 1] = f[:, sizes == 1].max(0)
    live = [_live(sizes, j) for j in range(len(e))] + [0]
    for j in range(1, len(e)):
        m, z = live[j], live[j + 1]
        old = f[:, :m]
        new = change[:, :m] + old.max(0)
        np.maximum(new, enter[:, :m], out=new)
        np.maximum(new[B:], old[B:] + on[:, :m], out=new[B:])
        np.maximum(new[B:], old[:B] + begun[:, :m], out=new[B:])
        new += e[j, :, :m]
        f = new
        np.maximum(best[:, :m], new, out=best[:, :m])
        if z < m:
            last[z:m] = new[:, z:m].max(0)
    return np.flatnonzero(np.maximum((best + leave[:, None]).max(0), last) >= -1e-2)


def viterbi(e, t, t0, sizes) -> np.ndarray:
    """Best labels (T, N) for the emissions of scores(); 0 beyond a lane."""
    T, _, n = e.shape
    live = [_live(sizes, k) for k in range(T)] + [0]
    order = np.r_[0, _ORDER]
    t, t0 = np.ascontiguousarray(t[np.ix_(order, order)].T), t0[order]  # to, from
    full = np.zeros((n, LABELS), np.float32)
    back = np.zeros((T, n, LABELS), np.int8)
    full[:, 1:] = e[0].T
    s = full + t0
    for k in range(1, T):
        m = live[k]
        a = s[:m, None, :] + t
        back[k, :m] = a.argmax(2)
        full[:m, 1:] = e[k, :, :m].T
        s[:m] = a.max(2) + full[:m]
    out = np.zeros((T, n), np.int64)
    last, cols = s.argmax(1), np.arange(n)
    for k in range(T - 1, -1, -1):
        a, b = live[k + 1], live[k]
        out[k, :a] = back[k + 1, cols[:a], out[k + 1, :a]] if a else 0
        out[k, a:b] = last[a:b]
    return np.where(np.arange(T)[:, None] < sizes, order[out], 0)


def cut(a: int, b: int) -> list[tuple[int, int]]:
    """Overlapping windows over a text."""
    if b - a <= WINDOW:
        return [(a, b)]
    return [(s, min(b, s + WINDOW)) for s in range(a, b - WINDOW + STRIDE, STRIDE)]


def reconcile(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str]]:
    """One set of disjoint spans from the windows' (start, end, kind, margin): overlapping spans of a kind
    become their union; of different kinds the one further from its window's edges stays, then the
    longer, then the earlier."""
    merged: list[list] = []
    for a, b, k, m in sorted(found, key=lambda s: (s[2], s[0], s[1])):
        if merged and merged[-1][2] == k and a < merged[-1][1]:
            merged[-1][1], merged[-1][3] = max(merged[-1][1], b), max(merged[-1][3], m)
        else:
            merged.append([a, b, k, m])
    kept: list[tuple[int, int, str]] = []
    for a, b, k, _ in sorted(merged, key=lambda s: (-s[3], s[0] - s[1], s[0])):
        if all(b <= x or a >= y for x, y, _ in kept):
            kept.append((a, b, k))
    return sorted(kept)


def find(texts: list[str], p: dict[str, np.ndarray], batch: int = LANES) -> list[list[tuple[int, int, str]]]:
    """The spans (start, end, kind) of each text, in characters."""
    work = [(i, s, e, len(text)) for i, text in enumerate(texts) if text for s, e in cut(0, len(text))]
    work.sort(key=lambda w: w[1] - w[2])
    found: list[list] = [[] for _ in texts]
    for at in range(0, len(work), batch):
        some = work[at:at + batch]
        sizes = np.array([e - s for _, s, e, _ in some])
        x = np.zeros((len(some), sizes[0]), np.int64)
        for n, (i, s, e, _) in enumerate(some):
            x[n, :e - s] = classes(texts[i][s:e])
        emitted = scores(p, np.ascontiguousarray(x.T), sizes)
        rows = doubtful(emitted, sizes, p["t"], p["t0"])
        if not len(rows):
            continue
        y = viterbi(emitted[:sizes[rows[0]]][:, :, rows], p["t"], p["t0"], sizes[rows])
        for n in np.flatnonzero(y.any(0)):
            i, s, e, b = some[rows[n]]
            v = y[:e - s, n]
            kind = np.where(v > 0, (v + 1) // 2, 0)
            begin = np.flatnonzero((kind > 0) & ((v % 2 == 1) | (np.concatenate(([0], kind[:-1])) != kind)))
            for u in begin:
                w = u + 1
                while w < len(v) and kind[w] == kind[u] and v[w] % 2 == 0:
                    w += 1
                margin = min(u if s > 0 else WINDOW, len(v) - w if e < b else WINDOW)
                found[i].append((s + int(u), s + int(w), KINDS[kind[u] - 1], int(margin)))
    out = []
    for text, spans in zip(texts, found):
        good = []
        for a, b, k in reconcile(spans):
            while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;"):
                b -= 1
            while a < b and text[a].isspace():
                a += 1
            if b - a >= LEAST:
                good.append((a, b, k))
        out.append(good)
    return out


SPANS = "array<struct<start:int,end:int,kind:string>>"


def personal_data(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """docs (text, ...) -> the same rows and columns with each span of text replaced by [KIND], and
    pii_spans added: array of (start, end, kind) in characters of the old text.

    Null texts stay null with null spans; empty texts and those without a span stay as they are, with an
    empty array.  Every character of a text is decoded, in overlapping windows however long it is.  Each window
    is a lane of its own and no padding enters its states, so a text's spans don't depend on the texts
    beside it and repeated rows get the same.  Of two kinds for one span reconcile() tells which stays.
    An empty table stays empty.  A column pii_spans is replaced, all others are kept whatever their names.
    Nothing is shuffled."""
    spark = ready(docs.sparkSession)
    weights = trained(steps)
    names = [c for c in docs.columns if c != "pii_spans"]

    @F.pandas_udf(f"text string, spans {SPANS}")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            known = [t if isinstance(t, str) else "" for t in texts]
            new, spans = [], []
            for t, own, old in zip(known, find(known, weights), texts):
                if not isinstance(old, str):
                    new.append(None), spans.append(None)
                    continue
                parts, at = [], 0
                for a, b, k in own:
                    parts += [t[at:a], f"[{k}]"]
                    at = b
                new.append("".join(parts) + t[at:]), spans.append([{"start": a, "end": b, "kind": k} for a, b, k in own])
            yield pd.DataFrame({"text": new, "spans": spans})

    made = unused(docs, "pii")
    done = docs.withColumn(made, redact("text"))
    return done.select(*[F.col(made)["text"].alias("text") if c == "text" else F.col(f"`{c}`") for c in names], F.col(made)["spans"].alias("pii_spans"))
