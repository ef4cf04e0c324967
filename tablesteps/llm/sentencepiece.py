"""SentencePiece encoding and decoding: a batched numpy Viterbi.

Words of equal length advance together, one character at a time.  At each
position the hashes of the substrings that end there probe the sorted
keys of the pieces; every piece found is an arc from an earlier position,
and the best arc is stored as a backpointer.

* A unigram model scores an arc by adding the piece's score to the best
  score of the position it leaves; the maximum wins.
* A BPE model (merge the best-ranked neighbours first) is walked by the same
  recursion: an arc is open only if merging would leave its piece beside
  the last piece of the position it leaves.  One arc is open at each
  position, and the path is exactly the result of the merges.  Whether two
  pieces stay side by side is decided by undoing their merges along
  the boundary, vectorised over the pairs and remembered.

Words are cut before every space, at characters the model lacks (they
become byte pieces), and between two characters that no piece holds side
by side: no piece crosses such a place, so the parts are independent.
A worker process remembers encoded words (see ``KNOWN_WORDS``), since few
different words make up most of a text.

Models: unigram or BPE with byte fallback, identity normalisation and a
dummy prefix; others raise ``ValueError``.  The path of the model file is a
parameter.  Only its tables (bounded by the vocabulary) go to the tasks.

Defined results: null and empty texts give an empty list of pieces and
decode to the empty text.  Decoding returns the encoded text exactly, but
for U+2581, which the format uses for a space and decodes as one.  Repeated
rows have equal results, and extra columns of any name pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import SLICE_ROWS, map_text, prepare_workers, quoted, texts_of

SPACE = "▁"
_SPACE = SPACE.encode()
#: Words a process remembers in each of two generations: when the younger is full it becomes
#: the elder, and the elder's words that are not met again are forgotten (bounds its memory).
KNOWN_WORDS = 150_000
#: Characters of new words advanced in one batch.
BATCH_CHARS = 1 << 19
#: Longer parts, and fewer parts of one length, are walked one by one: a batch gains nothing there.
LONG_PART = 256
FEW_PARTS = 32
#: Pairs of pieces remembered (a direct-mapped table).
PAIR_SLOTS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.int64(1) << np.int64(40)


class Pieces:
    """The tables of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = proto.ModelProto.SentencePiece
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type not in (1, 2) or not spec.byte_fallback:
            raise ValueError("only unigram and BPE models with byte fallback")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only identity normalisation with a dummy prefix")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.merges = spec.model_type == 2
        self.bytes = np.zeros(256, dtype=np.int32)  # id of each byte piece
        self.raw = []  # bytes of each id, for decoding
        self.ids = {}
        self.score = np.zeros(len(model.pieces))
        for i, p in enumerate(model.pieces):
            self.score[i] = p.score
            raw = b""
            if p.type == kinds.BYTE:
                raw = bytes([int(p.piece[3:5], 16)])
                self.bytes[raw[0]] = i
            elif p.type == kinds.NORMAL:
                raw = p.piece.encode()
                self.ids[p.piece] = i
            self.raw.append(raw)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans a word boundary")
        # Merging: runs of spaces merge last (they rank below all others), so words are walked without them.
        self.runs = {p: i for p, i in self.ids.items() if self.merges and len(p) > 1 and not p.strip(SPACE)}
        lowest = min((self.score[i] for p, i in self.ids.items() if p.strip(SPACE)), default=0.0)
        if any(self.score[i] > lowest for i in self.runs.values()):
            raise ValueError("a run of spaces ranks above a word's pieces")
        self.letters = sorted({c for p in self.ids for c in p})
        self.lines = "\n" not in self.letters  # a line break is a place to cut
        self.kind = np.uint16 if len(self.raw) <= 1 << 16 else np.int32  # of remembered ids
        self.name = f"{os.path.abspath(path)}:{hashlib.sha256(model.SerializeToString()).hexdigest()}"
        if any(c not in self.ids for c in self.letters):
            raise ValueError("a character of a piece is no piece itself")
        self.single = np.array([-1, *[self.ids[c] for c in self.letters]], dtype=np.int64)
        self._keys()
        if self.merges:
            self._merge_tables()

    def _keys(self) -> None:
        self.char = np.zeros(0x110000, dtype=np.int32)
        self.char[[ord(c) for c in self.letters]] = np.arange(1, len(self.letters) + 1)
        words = {p: i for p, i in self.ids.items() if p not in self.runs}
        self.longest = max(map(len, words))
        rows = np.zeros((len(self.raw), self.longest), dtype=np.int32)
        hashes = np.zeros(len(words), dtype=np.uint64)
        numbers = np.fromiter(words.values(), dtype=np.int32, count=len(words))
        pairs = set()
        for k, (p, i) in enumerate(words.items()):
            codes = self.char[[ord(c) for c in p]]
            rows[i, : len(p)] = codes
            h = 0
            for c in codes.tolist():
                h = (h * int(_BASE) + c) & (1 << 64) - 1
            hashes[k] = h
            pairs.update(zip(codes[:-1].tolist(), codes[1:].tolist()))
        order = np.argsort(hashes)
        self.keys, self.key_ids, self.rows = hashes[order], numbers[order], rows
        self.maybe = np.zeros(1 << 20, dtype=bool)  # spares most of the binary searches
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.beside = np.sort(np.array([a << 32 | b for a, b in pairs], dtype=np.int64))
        self.power = np.array([pow(int(_BASE), n, 1 << 64) for n in range(self.longest + 1)], dtype=np.uint64)

    def _merge_tables(self) -> None:
        """Rank of each piece, the two parts of its last merge, and the pairs that merge."""
        n = len(self.raw)
        order = sorted(self.ids.values(), key=lambda i: -self.score[i])
        self.rank = np.zeros(n, dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.left, self.right = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        self.time = np.full(n, -1, dtype=np.int64)  # when the merges make a piece; characters are there from the start
        both = {}
        for p, i in self.ids.items():
            if len(p) == 1 or p in self.runs:
                continue
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    both[a * n + b] = i
            parts, last = merged([self.ids[c] for c in p], self)
            if len(parts) > 1:
                continue  # merging never makes this piece: it stays closed
            self.left[i], self.right[i] = last
            self.time[i] = self.rank[i]
        open_ = [i for p, i in self.ids.items() if self.left[i] >= 0]
        if any(max(self.time[self.left[i]], self.time[self.right[i]]) > self.time[i] for i in open_):
            raise ValueError("a piece ranks before its parts")
        keys = np.array(sorted(both), dtype=np.int64)
        self.pair_keys, self.pair_rank = keys, self.rank[[both[k] for k in keys.tolist()]]
        single = np.zeros(n, dtype=bool)
        single[[self.ids[c] for c in self.letters]] = True
        self.reached = single | (self.left >= 0)

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of ``a`` and ``b`` ends with these two pieces side by side.

        The state of the boundary is the piece on either side of it.  From the end, the later of the two
        is undone again and again; the boundary breaks if in some state its two pieces merge before
        either of them is merged away from it (the leftmost of equals goes first).
        """
        n = len(self.raw)
        apart = np.ones(len(a), dtype=bool)
        until_a, until_b = np.full(len(a), _FAR), np.full(len(a), _FAR)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_rank[at], _FAR)
            broken = (rank < until_a[live]) & (rank <= until_b[live])
            apart[live[broken]] = False
            live = live[~broken]
            x, y = a[live], b[live]
            right_later = self.time[y] >= self.time[x]
            whole = np.maximum(self.time[x], self.time[y]) < 0
            undo_b, undo_a = live[right_later & ~whole], live[~right_later & ~whole]
            until_b[undo_b] = self.time[b[undo_b]]
            b[undo_b] = self.left[b[undo_b]]
            until_a[undo_a] = self.time[a[undo_a]]
            a[undo_a] = self.right[a[undo_a]]
            live = live[~whole]
        return apart


def merged(symbols: list[int], model: Pieces, runs: bool = False) -> tuple[list[int], tuple[int, int]]:
    """Plain merging, best score first and leftmost among equals; also the last pair merged."""
    text = [model.raw[i].decode() for i in symbols]
    after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
    table = model.ids if runs else None
    heap: list[tuple[float, int, str]] = []

    def offer(at: int) -> None:
        if 0 <= at and after[at] < len(text):
            whole = text[at] + text[after[at]]
            i = model.ids.get(whole)
            if i is not None and (table is not None or whole not in model.runs):
                heapq.heappush(heap, (-model.score[i], at, whole))

    for at in range(len(text) - 1):
        offer(at)
    last = (-1, -1)
    while heap:
        _, at, whole = heapq.heappop(heap)
        if text[at] and after[at] < len(text) and text[at] + text[after[at]] == whole:
            nxt = after[at]
            last = (model.ids[text[at]], model.ids[text[nxt]])
            text[at], text[nxt] = whole, ""
            after[at] = after[nxt]
            if after[at] < len(text):
                before[after[at]] = at
            offer(at)
            offer(before[at])
    return [model.ids[t] for t in text if t], last


def parts_of(text: bytes, lines: bool) -> list[bytes]:
    """What stands between spaces; every part follows one (the first the dummy prefix).

    With ``lines`` a part also begins at a line break; it then follows no space.
    """
    if not text:
        return []
    text = text.replace(_SPACE, b" ")
    return (text.replace(b"\n", b" \n") if lines else text).split(b" ")


def parts_with_runs(text: bytes, lines: bool) -> list[bytes]:
    """The same, with the further spaces of a run kept before the part that they precede."""
    out, held = [], 0
    for part in parts_of(text, lines):
        if part:
            out.append(b" " * held + part)
        held = 0 if part else held + 1
    return [*out, b" " * (held - 1)] if held else out


class Encoder:
    """What a process keeps between texts: remembered words and pairs."""

    def __init__(self, model: Pieces):
        self.model = model
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.run_ids: dict[int, bytes] = {}
        self.space = model.kind(model.ids[SPACE]).tobytes()
        self.pair_key = np.full(PAIR_SLOTS, -1, dtype=np.int64)
        self.pair_ok = np.zeros(PAIR_SLOTS, dtype=bool)
        self.pairs: dict[int, bool] = {}  # the same for parts walked alone

    # ---- texts
    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        m = self.model
        split = parts_of if m.merges else parts_with_runs
        words = [split(t, m.lines) for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = set().union(*words).difference(known)
        met = new.intersection(older)
        known.update((w, older[w]) for w in met)
        self._learn(list(new - met))
        out = []
        for row in words:
            flat = self._with_runs(row) if m.merges and b"" in row else b"".join(map(known.__getitem__, row))
            out.append(np.frombuffer(flat, dtype=m.kind))
        return out

    def _with_runs(self, row: list[bytes]) -> bytes:
        """Each part stands for a space and a word; empty parts are spaces of a run, which merge last."""
        parts, held = [], 0
        for w in row:
            if not w:
                held += 1
                continue
            ids = self.known[w]
            if held and ids.startswith(self.space):  # the word left its own space alone: it joins the run
                held, ids = held + 1, ids[len(self.space) :]
            parts += [self._run(held), ids]
            held = 0
        return b"".join([*parts, self._run(held)])

    def _run(self, n: int) -> bytes:
        if n not in self.run_ids:
            ids = merged([self.model.ids[SPACE]] * n, self.model, runs=True)[0]
            self.run_ids[n] = np.array(ids, dtype=self.model.kind).tobytes()
        return self.run_ids[n]

    # ---- words
    def _learn(self, words: list[bytes]) -> None:
        start, size = 0, 0
        for i, w in enumerate(words):
            size += len(w) + 1
            if size >= BATCH_CHARS or i + 1 == len(words):
                self._learn_batch(words[start : i + 1])
                start, size = i + 1, 0

    def _learn_batch(self, words: list[bytes]) -> None:
        m = self.model
        if m.merges:  # no part holds a space: all of them are decoded at once, and each space begins one
            words = [w for w in words if w]
            self.known[b""] = b""
            text = (b" " + b" ".join(words)).decode("utf-8", "surrogateescape") if words else ""
            text = (text.replace(" \n", "\n") if m.lines else text).replace(" ", SPACE)
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            ends = np.append(np.flatnonzero((code == ord(SPACE)) | m.lines & (code == 10))[1:], len(code))
        else:
            text = [self._whole(w) for w in words]
            ends = np.cumsum([len(t) for t in text])
            code = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not words:
            return
        char = m.char[code]
        first = np.zeros(len(code) + 1, dtype=bool)  # where a part begins
        first[ends] = True
        first[0] = True
        if len(code):
            pair = char[:-1].astype(np.int64) << 32 | char[1:]
            at = np.minimum(np.searchsorted(m.beside, pair), len(m.beside) - 1)
            first[1:-1] |= m.beside[at] != pair
        begins = np.flatnonzero(first[:-1])
        sizes = np.diff(np.append(begins, len(code)))
        out = np.full(len(code), -1, dtype=np.int64)  # ids of a part from the place where it begins
        for size in np.unique(sizes).tolist():
            rows = begins[sizes == size]
            if size == 1:
                out[rows] = m.single[char[rows]]
            elif size > LONG_PART or len(rows) < FEW_PARTS:
                for b in rows.tolist():
                    ids = self._walk_one("".join(map(chr, code[b : b + size].tolist())))
                    out[b : b + len(ids)] = ids
            else:
                step = max(1, BATCH_CHARS // size)
                for cut in range(0, len(rows), step):
                    places = rows[cut : cut + step][:, None] + np.arange(size)
                    out[places] = self._walk(char[places])
        lost = np.flatnonzero(char == 0)  # characters the model lacks
        used = out >= 0
        upto = np.concatenate([[0], np.cumsum(used)])
        stops = upto[ends] * np.dtype(m.kind).itemsize
        starts = np.concatenate([[0], stops[:-1]])
        flat = out[used].astype(m.kind).tobytes()
        self.known.update(zip(words, (flat[a:b] for a, b in zip(starts.tolist(), stops.tolist()))))
        begin = np.concatenate([[0], ends])
        for k in np.unique(np.searchsorted(ends, lost, side="right")).tolist():
            parts = []
            for p in range(int(begin[k]), int(begin[k + 1])):
                if char[p] == 0:
                    raw = chr(code[p]).encode("utf-8", "surrogateescape")
                    parts.append(m.bytes[np.frombuffer(raw, dtype=np.uint8)])
                elif out[p] >= 0:
                    parts.append(out[p : p + 1])
            self.known[words[k]] = np.concatenate(parts).astype(m.kind).tobytes()

    def _whole(self, part: bytes) -> str:
        """A part with the space it follows, if any."""
        word = part.lstrip(b" ")
        spaces = len(part) - len(word) + (not (self.model.lines and word.startswith(b"\n")))
        return SPACE * spaces + word.decode("utf-8", "surrogateescape")

    def _arcs(self, hashes: np.ndarray, chars: np.ndarray, end: int, size: int) -> np.ndarray:
        """Id of the piece that is each row's substring of ``size`` characters before ``end``; -1 if none."""
        m = self.model
        h = hashes[:, end] - hashes[:, end - size] * m.power[size]
        out = np.full(len(h), -1, dtype=np.int64)
        rows = np.flatnonzero(m.maybe[(h >> np.uint64(44)).astype(np.int64)])
        if len(rows):
            at = np.minimum(np.searchsorted(m.keys, h[rows]), len(m.keys) - 1)
            ids = m.key_ids[at]
            same = m.keys[at] == h[rows]
            same &= (m.rows[ids, :size] == chars[rows, end - size : end]).all(axis=1)
            out[rows[same]] = ids[same]
        return out

    def _open(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether merging keeps ``ids`` beside ``before``; remembered by pair."""
        m = self.model
        key = before * len(m.raw) + ids
        slot = ((key.astype(np.uint64) * _BASE) >> np.uint64(44)).astype(np.int64)
        miss = np.flatnonzero(self.pair_key[slot] != key)
        out = self.pair_ok[slot]
        if len(miss):
            fresh, back = np.unique(key[miss], return_inverse=True)
            ok = m.stay_apart(fresh // len(m.raw), fresh % len(m.raw))
            out[miss] = ok[back]
            own = ((fresh.astype(np.uint64) * _BASE) >> np.uint64(44)).astype(np.int64)
            self.pair_key[own], self.pair_ok[own] = fresh, ok
        return out

    def _open_one(self, before: int, i: int) -> bool:
        key = before * len(self.model.raw) + i
        if key not in self.pairs:
            if len(self.pairs) >= PAIR_SLOTS >> 4:
                self.pairs.clear()
            self.pairs[key] = bool(self.model.stay_apart(np.array([before]), np.array([i]))[0])
        return self.pairs[key]

    def _walk(self, chars: np.ndarray) -> np.ndarray:
        """Ids (from the left of each row, then -1) for words of equal length."""
        m = self.model
        n, length = chars.shape
        hashes = np.zeros((n, length + 1), dtype=np.uint64)
        for j in range(length):
            hashes[:, j + 1] = hashes[:, j] * _BASE + chars[:, j].astype(np.uint64)
        last = np.full((n, length + 1), -1, dtype=np.int64)  # piece that ends here
        back = np.zeros((n, length + 1), dtype=np.int64)  # its length
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0.0
        for end in range(1, length + 1):
            for size in range(min(m.longest, end), 0, -1):
                ids = self._arcs(hashes, chars, end, size)
                rows = np.flatnonzero((ids >= 0) & (best[:, end - size] > -np.inf))
                if m.merges:
                    rows = rows[m.reached[ids[rows]] & (best[rows, end] == -np.inf)]
                    before = last[rows, end - size]
                    if size < end and len(rows):
                        rows = rows[self._open(before, ids[rows])]
                    best[rows, end] = 0.0
                else:
                    value = best[rows, end - size] + m.score[ids[rows]]
                    rows = rows[value > best[rows, end]]
                    best[rows, end] = best[rows, end - size] + m.score[ids[rows]]
                last[rows, end], back[rows, end] = ids[rows], size
        out = np.full((n, length), -1, dtype=np.int64)
        count = np.zeros(n, dtype=np.int64)
        at = np.full(n, length)
        live = np.arange(n)
        while len(live):  # from the right, then turned round
            out[live, count[live]] = last[live, at[live]]
            count[live] += 1
            at[live] -= back[live, at[live]]
            live = live[at[live] > 0]
        turn = count[:, None] - 1 - np.arange(length)
        return np.where(turn >= 0, np.take_along_axis(out, np.maximum(turn, 0), axis=1), -1)

    def _walk_one(self, text: str) -> list[int]:
        """The same walk over one long part."""
        m = self.model
        best, last, back = [0.0], [-1], [0]
        for end in range(1, len(text) + 1):
            top, piece, length = -np.inf, -1, 0
            for size in range(min(m.longest, end), 0, -1):
                i = m.ids.get(text[end - size : end])
                if i is None or best[end - size] == -np.inf:
                    continue
                if m.merges:
                    if not m.reached[i]:
                        continue
                    if size == end or self._open_one(last[end - size], i):
                        top, piece, length = 0.0, i, size
                        break
                elif best[end - size] + m.score[i] > top:
                    top, piece, length = best[end - size] + m.score[i], i, size
            best.append(top)
            last.append(piece)
            back.append(length)
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= back[at]
        return ids[::-1]


_KEPT: dict[str, Encoder] = {}


def encoder_of(model: Pieces) -> Encoder:
    """The process's encoder for a model; tasks that follow in it go on with what it remembers."""
    if model.name not in _KEPT:
        _KEPT.clear()
        _KEPT[model.name] = Encoder(model)
    return _KEPT[model.name]


def encode(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text", out: str = "piece_ids") -> DataFrame:
    """``keep`` columns and ``out``, the piece ids of the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        encoder = encoder_of(sent.value)
        return lambda texts: [listed(encoder.encode(texts_of(texts)))]

    return map_text(docs, text_col, keep, [StructField(out, ArrayType(IntegerType()))], make)


def listed(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, np.concatenate(ids).astype(np.int32))


def encode_and_decode(
    docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text", ids_col: str = "piece_ids", out: str = "decoded"
) -> DataFrame:
    """``keep`` columns, the piece ids and the text they decode to, in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        encoder = encoder_of(sent.value)

        def run(texts: pa.Array) -> list[pa.Array]:
            ids = encoder.encode(texts_of(texts))
            return [listed(ids), pa.array([decode_ids(x, encoder.model.raw) for x in ids], pa.string())]

        return run

    fields = [StructField(ids_col, ArrayType(IntegerType())), StructField(out, StringType())]
    return map_text(docs, text_col, keep, fields, make)


def decode_ids(ids: np.ndarray, raw: list[bytes]) -> str:
    """The text of piece ids; the dummy prefix goes. Ids outside the model are an error."""
    text = b"".join(map(raw.__getitem__, ids.tolist())).replace(_SPACE, b" ")
    return text[text.startswith(b" ") :].decode("utf-8", "replace")


def decode(coded: DataFrame, model_path: str, keep: list[str], ids_col: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``keep`` columns and ``out``, the text of the piece ids (empty for null)."""
    prepare_workers(coded.sparkSession)
    sent = coded.sparkSession.sparkContext.broadcast(Pieces(model_path).raw)
    source = coded.select(
        F.col(quoted(ids_col)).cast("array<int>").alias("ids"), *[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)]
    )
    schema = StructType([*source.schema.fields[1:], StructField("out", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                flat = part.column(0).fill_null([])
                at = flat.offsets.to_numpy()
                values = flat.values.to_numpy()
                texts = [decode_ids(values[a:b], raw) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, out)
