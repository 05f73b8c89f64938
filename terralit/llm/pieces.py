"""SentencePiece encoding and decoding over an Aho-Corasick automaton (operator 7)."""

from __future__ import annotations

import functools
import heapq
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ready

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
KEEP = 1 << 16
FAST, SLICE = 0x100, 2_000_000
UNK_PENALTY = 10.0
_CHUNK = re.compile(SPACE + "*[^" + SPACE + "]*")


class Pieces:
    """Encoder and decoder of one model.

    One pass of the automaton gives, for each end position, the pieces that end there: the state's own
    and, by its output links, each shorter suffix.  Every one relaxes the best path to that position.
    For a unigram model the best path has the greatest sum of scores.  For a BPE model a piece can follow
    only a path whose last piece it is compatible with, that is, if merging both pieces' characters
    anew gives just these two; exactly one path then reaches each position, the one merging gives."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = BPE, dummy_prefix: bool = True, byte_fallback: bool = True, unk: int = 0):
        self.kind, self.dummy, self.unk = kind, dummy_prefix, unk
        self.pieces = [p for p, _, _ in pieces]
        self.scores = [s for _, s, _ in pieces]
        self.types = [t for _, _, t in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE} if byte_fallback else {}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unk_score = min([self.scores[i] for i in self.ids.values()], default=0.0) - UNK_PENALTY
        self.automaton = ahocorasick.Automaton()
        self.pair = functools.lru_cache(maxsize=KEEP)(self._pair)
        for p, i in self.ids.items():
            if kind != BPE or len(p) == 1 or self.merged(p) == [p]:
                self.automaton.add_word(p, (i, len(p)))
        if self.ids:
            self.automaton.make_automaton()
        #: No piece crosses the start of a word, so words can be encoded alone, and each once.
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.words: dict[str, np.ndarray] = {}

    @classmethod
    def load(cls, path: str) -> "Pieces":
        from sentencepiece import sentencepiece_model_pb2 as pb
        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.name != "identity" and n.precompiled_charsmap or n.remove_extra_whitespaces:
            raise ValueError(f"{path}: only models without normalisation are read")
        return cls([(p.piece, p.score, p.type) for p in m.pieces], m.trainer_spec.model_type, n.add_dummy_prefix, m.trainer_spec.byte_fallback, m.trainer_spec.unk_id)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging makes of text: the best-scored adjacent pair first, then the leftmost."""
        part, right, left = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(a: int):
            if a >= 0 and right[a] < len(part):
                both = part[a] + part[right[a]]
                if (i := self.ids.get(both)) is not None:
                    heapq.heappush(heap, (-self.scores[i], a, both, right[a]))
        for a in range(len(part)):
            offer(a)
        while heap:
            _, a, both, b = heapq.heappop(heap)
            if not part[a] or right[a] != b or not part[b] or part[a] + part[b] != both:
                continue
            part[a], part[b] = both, ""
            right[a] = right[b]
            if right[a] < len(part):
                left[right[a]] = a
            offer(left[a])
            offer(a)
        return [p for p in part if p]

    def _pair(self, a: int, b: int) -> bool:
        return self.merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]

    def path(self, text: str) -> list[tuple[int, int]]:
        """(piece or -1 for an unknown character, start) of each piece of text, by one pass."""
        n = len(text)
        best, score = [(-1, k) for k in range(n)], [0.0] * (n + 1)
        reached = [False] * n
        bpe = self.kind == BPE

        def close(k: int):  # position k+1: an unknown character, if no piece ends here
            if not reached[k] or not bpe and score[k] + self.unk_score > score[k + 1]:
                if not reached[k]:
                    best[k], score[k + 1] = (-1, k), score[k] + self.unk_score

        done = 0
        if self.ids:
            for end, (i, size) in self.automaton.iter(text):
                while done < end:
                    close(done)
                    done += 1
                start = end + 1 - size
                if bpe:
                    if not reached[end]:
                        before = best[start - 1][0] if start else -1
                        if before < 0 or self.pair(before, i):
                            best[end], reached[end] = (i, start), True
                else:
                    s = score[start] + self.scores[i]
                    if not reached[end] or s > score[end + 1]:
                        best[end], score[end + 1], reached[end] = (i, start), s, True
        while done < n:
            close(done)
            done += 1
        out = []
        k = n
        while k:
            i, start = best[k - 1]
            out.append((i, start))
            k = start
        return out[::-1]

    def word(self, text: str) -> np.ndarray:
        got = self.words.get(text)
        if got is None:
            ids: list[int] = []
            for i, start in self.path(text):
                if i >= 0:
                    ids.append(i)
                elif self.bytes:
                    ids += [self.bytes[b] for b in text[start].encode("utf-8", "replace")]
                elif not ids or ids[-1] != self.unk:
                    ids.append(self.unk)
            got = np.array(ids, np.int32)
            if len(text) <= 64:
                if len(self.words) >= KEEP:
                    self.words.clear()
                self.words[text] = got
        return got

    @functools.cached_property
    def tables(self):
        """The automaton over the characters below FAST and U+2581 as arrays: the state after each state
        and character, and each state's piece, its length and its output link."""
        order, number, down = [""], {"": 0}, {}
        for w in sorted((w for w in self.ids if w in self.automaton and all(self._code(c) <= FAST for c in w)), key=len):
            for k in range(1, len(w) + 1):
                if w[:k] not in number:
                    number[w[:k]] = -1
                    down.setdefault(w[:k - 1], []).append(w[k - 1])
        for node in order:
            for c in down.get(node, ()):
                number[node + c] = len(order)
                order.append(node + c)
        n = len(order)
        go = np.zeros((n, FAST + 1), np.int32)
        piece, size, link = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.full(n, -1, np.int32)
        fail = np.zeros(n, np.int32)
        for k, node in enumerate(order):  # by length, so the state that k falls back to is complete
            if k:
                go[k] = go[fail[k]]
                if node in self.ids and node in self.automaton:
                    piece[k], size[k] = self.ids[node], len(node)
                link[k] = fail[k] if piece[fail[k]] >= 0 else link[fail[k]]
            for c in down.get(node, ()):
                b = number[node + c]
                fail[b] = go[k, self._code(c)] if k else 0
                go[k, self._code(c)] = b
        return go, piece, size, link

    @staticmethod
    def _code(c: str) -> int:
        return FAST if c == SPACE else ord(c) if ord(c) < FAST else FAST + 1

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair of pieces, whether merging leaves it as it is; remembered in a table by hash."""
        if not hasattr(self, "known"):
            self.known, self.told = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        key = a.astype(np.int64) * len(self.pieces) + b
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        out = self.told[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            said = np.array([self._pair(*divmod(int(k), len(self.pieces))) for k in keys])
            out[new] = said[back]
            self.known[slot[new]], self.told[slot[new]] = key[new], out[new]
        return out

    def paths(self, words: list[str], block: int = 1 << 15) -> list[np.ndarray]:
        """The ids of many words of a BPE model at once: path() over all of them side by side, a character
        at a time.  Words with characters that tables lacks, and very long ones, go through word()."""
        out: list[np.ndarray | None] = [None] * len(words)
        size = np.array([len(w) for w in words])
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        code[code == ord(SPACE)] = FAST
        begin = np.cumsum(size) - size
        odd = np.zeros(len(words), bool)
        strange = np.flatnonzero((code > FAST))
        odd[np.searchsorted(begin + size, strange, side="right")] = True
        odd |= (size > 64) | (size == 0)
        for k in np.flatnonzero(odd):
            out[k] = self.word(words[k]) if words[k] else np.zeros(0, np.int32)
        go, piece, length, link = self.tables
        rest = np.flatnonzero(~odd)
        rest = rest[np.argsort(size[rest], kind="stable")]
        for lo in range(0, len(rest), block):
            own = rest[lo:lo + block]
            n, most = len(own), int(size[own[-1]])
            best, start = np.full((most + 1, n), -1, np.int32), np.zeros((most, n), np.int32)
            state = np.zeros(n, np.int32)
            for t in range(most):
                live = np.flatnonzero(size[own] > t)
                state[live] = go[state[live], code[begin[own[live]] + t]]
                start[t] = t
                at, cur = live, state[live]
                cur = np.where(piece[cur] >= 0, cur, link[cur])
                while True:
                    more = cur >= 0
                    at, cur = at[more], cur[more]
                    if not len(at):
                        break
                    i, s = piece[cur], t + 1 - length[cur]
                    before = best[s - 1, at]  # row -1 is the start of the word and stays -1
                    ok = before < 0
                    todo = np.flatnonzero(~ok)
                    ok[todo] = self.compatible(before[todo], i[todo])
                    best[t, at[ok]], start[t, at[ok]] = i[ok], s[ok]
                    at, cur = at[~ok], link[cur[~ok]]
            marks = np.zeros((n, most), bool)
            k = size[own] - 1
            live = np.arange(n)
            while len(live):
                marks[live, k] = True
                k = start[k, live] - 1
                live, k = live[k >= 0], k[k >= 0]
            ids = best[:most].T[marks]
            ends = np.concatenate(([0], np.cumsum(marks.sum(1))))
            unknown = np.add.reduceat(ids < 0, ends[:-1]) > 0
            for j, w in enumerate(own):
                out[w] = self.word(words[w]) if unknown[j] else ids[ends[j]:ends[j + 1]]
        return out

    def normal(self, text: str) -> str:
        return (SPACE if self.dummy and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> np.ndarray:
        text = self.normal(text)
        if not text:
            return np.zeros(0, np.int32)
        if not self.by_word:
            return self.word(text)
        return np.concatenate([self.word(w) for w in _CHUNK.findall(text) if w])

    def decode(self, ids) -> str:
        """The text of the pieces; bytes of byte pieces are joined, and where they aren't UTF-8 give
        replacement characters.  Control pieces have no text; the unknown piece gives U+2047 in blanks."""
        out, held = [], bytearray()
        for i in ids:
            i = int(i)
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(" \u2047 " if i == self.unk else "" if self.types[i] == CONTROL else self.pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text

    def encode_many(self, texts: pa.Array) -> pa.ListArray:
        """Token ids of a column.  Words are told apart and counted in Arrow, so each distinct word of a
        batch is encoded once and the rest is a gather."""
        texts = pc.cast(texts, pa.large_string())
        if not self.by_word:
            rows = [None if t is None else self.encode(t) for t in texts.to_pylist()]
            return pa.array([None if r is None else r.tolist() for r in rows], pa.list_(pa.int32()))
        marked = pc.replace_substring(texts, " ", SPACE)
        if self.dummy:
            lead, glue = pa.scalar(SPACE, pa.large_string()), pa.scalar("", pa.large_string())
            marked = pc.if_else(pc.equal(texts, ""), marked, pc.binary_join_element_wise(lead, marked, glue))
        # A break before each run of blanks: NUL can't come out of the split, so texts with NUL go the slow way.
        split = pc.split_pattern(pc.replace_substring_regex(marked, "([^" + SPACE + "])" + SPACE, "\\1\x00" + SPACE), "\x00")
        sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(split).dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        known = self.paths(distinct) if self.kind == BPE and self.ids else [self.word(w) if w else np.zeros(0, np.int32) for w in distinct]
        ids = np.concatenate([*known, np.zeros(0, np.int32)])
        n = np.array([len(k) for k in known], np.int64)
        begin = np.cumsum(n) - n
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        per = n[code] if len(code) else np.zeros(0, np.int64)
        at = np.repeat(begin[code] - np.cumsum(per) + per, per) + np.arange(int(per.sum())) if len(code) else np.zeros(0, np.int64)
        tokens = ids[at]
        del at
        word_ends = np.concatenate(([0], np.cumsum(per)))
        ends = word_ends[np.concatenate(([0], np.cumsum(sizes)))]
        out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens), mask=pc.is_null(texts))
        odd = np.flatnonzero(pc.fill_null(pc.match_substring(texts, "\x00"), False).to_numpy(zero_copy_only=False))
        if len(odd):
            rows = out.to_pylist()
            for k in odd:
                rows[k] = self.encode(texts[int(k)].as_py()).tolist()
            out = pa.array(rows, pa.list_(pa.int32()))
        return out

    def decode_many(self, ids: pa.ListArray) -> pa.Array:
        """Texts of a column of token ids: a gather of the pieces' bytes, with the slow way for rows that
        hold byte, control or unknown pieces."""
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        plain = np.array([t in (NORMAL, USER, UNUSED) for t in self.types])
        words = pa.array([p.replace(SPACE, " ") for p in self.pieces], pa.string()).take(pa.array(flat))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        joined = pc.cast(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words), ""), pa.large_string())
        if self.dummy:
            joined = pc.replace_substring_regex(joined, "^ ", "")
        rare = np.unique(np.searchsorted(ends, np.flatnonzero(~plain[flat]), side="right") - 1) if len(flat) else []
        if len(rare):
            slow = joined.to_pylist()
            for r in rare:
                slow[r] = self.decode(flat[ends[r]:ends[r + 1]])
            joined = pa.array(slow, pa.large_string())
        return pc.if_else(pc.is_null(ids), pa.scalar(None, pa.large_string()), joined)


@functools.lru_cache(maxsize=4)
def model(path: str) -> Pieces:
    return Pieces.load(path)


def _batches(df: DataFrame, column: str, made: list[T.StructField], convert) -> DataFrame:
    """df with the fields `made` from `column` in Arrow batches, all other columns passed on untouched."""
    own = {f.name for f in made}
    names = [c for c in df.columns if c not in own]
    at = names.index(column)
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in own), *made])

    def run(batches):
        for whole in batches:
            step = max(1, len(whole) * SLICE // max(1, whole.nbytes))
            for lo in range(0, max(1, len(whole)), step):  # so many rows at a time that working arrays stay small
                b = whole.slice(lo, step)
                yield pa.RecordBatch.from_arrays([*b.columns, *convert(b.column(at))], names=[*b.schema.names, *(f.name for f in made)])

    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


TOKENS = T.StructField("tokens", T.ArrayType(T.IntegerType()))


def encode(df: DataFrame, column: str = "text", path: str = MODEL) -> DataFrame:
    """df with tokens (array<int>): the ids of the pieces of a text column.

    Null texts give null, empty texts no tokens.  Texts are encoded whole, however long; characters the
    model lacks become byte pieces.  Of equally good paths the one found first stays, so ties are broken
    alike everywhere.  Rows are independent, so repeated rows get the same tokens, and nothing is
    shuffled; an empty table gives none.  A column tokens is replaced, all others are kept."""
    ready(df.sparkSession)
    return _batches(df, column, [TOKENS], lambda a: [model(path).encode_many(a)])


def decode(df: DataFrame, column: str = "tokens", path: str = MODEL, name: str = "decoded") -> DataFrame:
    """df with decoded (string): the text of an array of ids.  Null gives null, no tokens an empty text;
    a column of that name is replaced.  What encode() made of a text without a NUL or U+2581 decodes to
    that text."""
    ready(df.sparkSession)
    return _batches(df, column, [T.StructField(name, T.StringType())], lambda a: [pc.cast(model(path).decode_many(a), pa.string())])


def verified(df: DataFrame, column: str = "text", path: str = MODEL) -> DataFrame:
    """encode() and decode() in one pass: df with tokens, and round_trip (boolean), whether the tokens
    decode to the very text (null to null).  One worker holds one model, and the decoded text stays
    in it."""
    ready(df.sparkSession)

    def both(texts: pa.Array) -> list[pa.Array]:
        tokens = model(path).encode_many(texts)
        same = pc.equal(model(path).decode_many(tokens), pc.cast(texts, pa.large_string()))
        return [tokens, pc.fill_null(same, True)]  # null where both are

    return _batches(df, column, [TOKENS, T.StructField("round_trip", T.BooleanType())], both)
