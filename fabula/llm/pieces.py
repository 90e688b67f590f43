"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice of pieces over a text is walked once, left to right. For each
boundary one backpointer survives, only the last max-piece-length boundaries can
still be extended, and ids are committed where every surviving backpointer path runs
through one boundary. One such boundary is known beforehand where no piece may span it
(a space after something else): what lies between two of them is a stream of its own,
so that many of them go in lock step, and what a short one gave is remembered.

For unigram models the survivor is the best-scoring path. For BPE models it is
the merge-consistent one: a piece may follow another only where merging the two
texts would give just these two pieces, which leaves exactly one path to each
boundary, and that path is the library's own BPE result.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, extended

SPACE = "▁"
#: Stands for U+2581 in a text; no word has the mark after another character.
LITERAL = "\0▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
#: Bounds of a worker's caches: segments, pairs of pieces, characters of a segment.
WORDS, PAIRS, WORD = 300_000, 500_000, 64
#: Streams that go in lock step, and characters whose segments are met together.
LANES, SLAB = 1 << 14, 1 << 20


def _fields(data: bytes):
    """(field, value) of a protocol buffer message; fixed-width values as bytes."""
    i = 0

    def varint(i):
        n = s = 0
        while True:
            c = data[i]
            n |= (c & 127) << s
            i, s = i + 1, s + 7
            if c < 128:
                return n, i

    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        elif tag & 7 == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class PieceModel:
    """A SentencePiece model with byte fallback and the identity normaliser."""

    def __init__(self, data: bytes):
        self.data, self.unigram, self.dummy_prefix = data, True, True
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(own.get(3, NORMAL))
            elif field == 2:
                self.unigram = dict(_fields(value)).get(3, 1) == 1
            elif field == 3:
                own = dict(_fields(value))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("only the identity normaliser that keeps white space is exact")
                self.dummy_prefix = bool(own.get(3, 1))
        self.scores = scores
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("exact decoding needs all byte pieces")
        self.longest = max(map(len, self.ids))
        #: No piece spans from a non-space into a space: every such place is a boundary of all paths.
        self.breaks = not any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:]))
        self.unknown = min(scores[i] for i in self.ids.values()) - 10.0

    @cached_property
    def alphabet(self) -> set[str]:
        return {c for p in self.ids for c in p}

    @cached_property
    def table(self) -> list[bytes]:
        """The bytes that each id stands for."""
        return [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else b"" for p, k in zip(self.pieces, self.kinds)]

    def merged(self, text: str) -> list[str]:
        """BPE of a short string by merging its best-scoring adjacent pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.scores[self.ids[parts[i] + parts[i + 1]]] if parts[i] + parts[i + 1] in self.ids else -np.inf, -i))
            if parts[best] + parts[best + 1] not in self.ids:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts


class Encoder:
    """Encodes texts; holds bounded caches and is made once a task."""

    def __init__(self, model: PieceModel):
        self.m, self.streams = model, Streams(model)
        self.words: dict[str, bytes] = {}  # ids as little-endian int32
        self.newline = "\n" not in model.alphabet

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none. U+2581 itself goes by bytes,
        since as a piece it would decode to a space."""
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. Segments of SLAB characters are met together, across texts
        and within long ones; beside ids, no more is held."""
        parts: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for n, text in enumerate(texts):
            for w, window in enumerate(windows(text, SLAB if self.m.breaks else len(text)) if text else ()):
                held.append((n, self.segments(window, first=w == 0)))
                size += len(window)
                if size >= SLAB:
                    self._meet(held, parts)
                    held, size = [], 0
        self._meet(held, parts)
        return [np.frombuffer(b"".join(p), "<i4") for p in parts]

    def _meet(self, held: list[tuple[int, list[str]]], parts: list[list[bytes]]) -> None:
        """Files the ids of segments; those that are not known yet are streamed."""
        if len(self.words) > WORDS or not self.words:
            self.words.clear()
            self.words[LITERAL] = packed([self.m.bytes[b] for b in SPACE.encode()])
        new = list({s for _, own in held for s in own if s not in self.words})
        self.words.update(zip(new, self.streams.encode(new)))
        for n, own in held:
            parts[n].append(b"".join(map(self.words.__getitem__, own)))
        for s in new:
            if len(s) > WORD:
                del self.words[s]

    def segments(self, text: str, first: bool = True) -> list[str]:
        """What a text consists of between boundaries that all paths share."""
        out: list[str] = []
        for k, part in enumerate(text.split(SPACE)):
            if k:
                out.append(LITERAL)
            part = part.replace(" ", SPACE)
            if k == 0 and first and self.m.dummy_prefix:
                part = SPACE + part
            for j, line in enumerate(part.split("\n") if self.newline else (part,)):
                if j:
                    out.append("\n")
                out += self.split(line)
        return out

    def split(self, part: str) -> list[str]:
        """Cuts before each run of spaces that follows something else, where all paths meet."""
        if not self.m.breaks:
            return [part] if part else []
        if not part:
            return []
        words, run = [], ""
        for w in part.split(SPACE)[1:] if part.startswith(SPACE) else part.split(SPACE):
            if w:
                words.append(run + SPACE + w)
                run = ""
            else:
                run += SPACE
        if not part.startswith(SPACE) and words:
            words[0] = words[0].removeprefix(SPACE)
        if run:
            words.append(run)
        return words


BREAK = re.compile("(?<=[^ ]) ")


def windows(text: str, size: int):
    """A text in parts of about so many characters, cut where a space follows something else."""
    start = 0
    while start < len(text):
        cut = BREAK.search(text, start + size)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


class Streams:
    """Streaming Viterbi passes over many segments in lock step, a character a step.

    A lane is a segment. Each step extends the pieces that were begun at one of the last
    `longest` boundaries, by a hashed trie, and files the one surviving backpointer of the
    new boundary: for BPE the first piece, from the longest, that is merge-consistent with
    what it follows; for unigram models the one of the best score, ties to the longest.
    Backpointers are held for a window of a few `longest` boundaries; when it is full,
    each lane commits the ids up to the boundary that all its surviving paths share.
    """

    START, NONE = -1, -2

    def __init__(self, model: PieceModel):
        self.m, self.longest, self.count = model, model.longest, len(model.pieces)
        children: list[dict[str, int]] = [{}]
        ids = [-1]
        for piece, i in model.ids.items():
            node = 0
            for c in piece:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ids.append(-1)
                node = children[node][c]
            ids[node] = i
        self.ids, self.leaf = np.array(ids, np.int64), np.array([not c for c in children])
        self._file([(at << 21 | ord(c), to) for at, own in enumerate(children) for c, to in own.items()])
        self.sizes = np.array([len(p) for p in model.pieces], np.int64)
        self.scores = np.array(model.scores)
        self.known, self.valid = np.array([-1], np.int64), np.array([False])
        self.recent: dict[int, bool] = {}

    def _file(self, edges: list[tuple[int, int]]) -> None:
        """The trie's edges in an open-addressing table."""
        self.shift = 64 - max(4, (4 * len(edges)).bit_length())
        size = 1 << (64 - self.shift)
        self.edge, self.to = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int64)
        keys, to = (np.array(x, np.int64) for x in zip(*edges))
        slots = self._slot(keys)
        while len(keys):
            free = self.edge[slots] < 0
            own, first = np.unique(slots[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.edge[own], self.to[own] = keys[put], to[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, to, slots = keys[rest], to[rest], slots[rest] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node that each character leads to, -1 for none."""
        keys = nodes << 21 | chars
        slots = self._slot(keys)
        there = self.edge[slots]
        out = np.where(there == keys, self.to[slots], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slots[left] += 1
            there = self.edge[slots[left]]
            hit = there == keys[left]
            out[left[hit]] = self.to[slots[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out

    def allowed(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether merging two pieces gives just these two: known pairs by search, the few
        new ones by merging."""
        codes = (before + 1) << 21 | piece
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        out, missing = self.valid[at], np.flatnonzero(self.known[at] != codes)
        if len(missing):
            fresh, where = np.unique(codes[missing], return_inverse=True)
            out[missing] = np.array([self._fresh(c) for c in fresh.tolist()])[where]
        return out

    def _fresh(self, code: int) -> bool:
        known = self.recent.get(code)
        if known is None:
            text = lambda i: self.m.pieces[i] if i < self.count else chr(i - self.count)
            before, piece = (code >> 21) - 1, text(code & 0x1FFFFF)
            known = self.m.merged(piece) == [piece] and (before < 0 or self.m.merged(text(before) + piece) == [text(before), piece])
            self.recent[code] = known
        return known

    def settle(self) -> None:
        """Files the pairs met lately; forgets all where the bound is reached."""
        if len(self.known) + len(self.recent) > PAIRS:
            self.known, self.valid = np.array([-1], np.int64), np.array([False])
        elif self.recent:
            keys = np.concatenate([self.known, np.array(list(self.recent), np.int64)])
            order = np.argsort(keys)
            self.known, self.valid = keys[order], np.concatenate([self.valid, np.array(list(self.recent.values()))])[order]
        self.recent = {}

    def encode(self, segments: list[str]) -> list[bytes]:
        """Packed ids of each segment."""
        out = [b""] * len(segments)
        order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
        for start in range(0, len(order), LANES):
            lanes = order[start : start + LANES]
            for i, ids in zip(lanes, self._run([segments[i] for i in lanes])):
                out[i] = ids
            self.settle()
        return out

    def _run(self, texts: list[str]) -> list[bytes]:
        """encode() of some segments, longest first."""
        lengths = np.array([len(t) for t in texts], np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        out: list[bytes] = [b""] * len(texts)
        rows = min(int(lengths[0]), 4 * self.longest) + 1 if len(texts) else 1
        last = np.full((rows, len(texts)), self.NONE, np.int64)  # the last piece at each boundary from `base` on
        last[0] = self.START
        score = np.zeros(last.shape) if self.m.unigram else None
        base, done = 0, np.zeros(len(texts), np.int64)  # all lanes' and each lane's committed boundary
        walks: list[tuple[int, np.ndarray, np.ndarray]] = []  # pieces begun: boundary, lanes, trie nodes
        for end in range(1, int(lengths[0]) + 1 if len(texts) else 0):
            live = int(np.searchsorted(-lengths, -end, "right"))
            chars_now = chars[offsets[:live] + end - 1]
            now = last[end - base, :live]
            best = score[end - base, :live] if self.m.unigram else None
            lanes = np.flatnonzero(last[end - 1 - base, :live] != self.NONE)
            walks.append((end - 1, lanes, np.zeros(len(lanes), np.int64)))
            on = []
            for start, lanes, nodes in walks:  # from the longest piece to the shortest
                if len(lanes) and lanes[-1] >= live:
                    cut = np.searchsorted(lanes, live)
                    lanes, nodes = lanes[:cut], nodes[:cut]
                nodes = self.step(nodes, chars_now[lanes])
                pieces = np.where(nodes >= 0, self.ids[nodes], -1)
                if start == end - 1:  # a character that is no piece stands for itself
                    pieces = np.where(pieces >= 0, pieces, self.count + chars_now[lanes])
                self._file_best(now, best, last[start - base], score[start - base] if self.m.unigram else None, lanes, pieces)
                deeper = (nodes >= 0) & ~self.leaf[nodes]
                if deeper.any():
                    on.append((start, lanes[deeper], nodes[deeper]))
            walks = on
            over = int(np.searchsorted(-lengths, -end - 1, "right"))
            if over < live:
                self._commit(np.arange(over, live), np.full(live - over, end), last, base, done, out)
            if end - base == len(last) - 1 and over:
                meet = self._meets(last, base, end, over)
                go = np.flatnonzero(meet > done[:over])
                self._commit(go, meet[go], last, base, done, out)
                to = max(base, min(int(done[:over].min()), end - self.longest))
                free = np.full((len(last) if to - base >= self.longest else 2 * len(last), over), self.NONE, np.int64)
                free[: end - to + 1] = last[to - base : end - base + 1, :over]
                last = free
                if self.m.unigram:
                    more = np.zeros(last.shape)
                    more[: end - to + 1] = score[to - base : end - base + 1, :over]
                    score = more
                base = to
        return out

    def _file_best(self, now, best, before, score, lanes, pieces) -> None:
        """Puts pieces that end at a boundary where they are better than what is there."""
        if self.m.unigram:
            there = pieces >= 0
            lanes, pieces = lanes[there], pieces[there]
            total = score[lanes] + np.where(pieces < self.count, self.scores[np.minimum(pieces, self.count - 1)], self.m.unknown)
            better = (now[lanes] == self.NONE) | (total > best[lanes])
            now[lanes[better]], best[lanes[better]] = pieces[better], total[better]
        else:
            there = (pieces >= 0) & (now[lanes] == self.NONE)
            if there.any():
                lanes, pieces = lanes[there], pieces[there]
                ok = self.allowed(before[lanes], pieces)
                now[lanes[ok]] = pieces[ok]

    def _width(self, pieces: np.ndarray) -> np.ndarray:
        return np.where(pieces < self.count, self.sizes[np.minimum(pieces, self.count - 1)], 1)

    def _meets(self, last: np.ndarray, base: int, end: int, live: int) -> np.ndarray:
        """Of each lane, the boundary that the paths to its last `longest` boundaries share."""
        marks = np.zeros((end - base + 1, live), bool)
        tip = max(0, end - base + 1 - self.longest)
        marks[tip:] = last[tip : end - base + 1, :live] != self.NONE
        heads = marks.sum(axis=0)
        for at in range(end - base, 0, -1):
            lanes = np.flatnonzero(marks[at] & (heads > 1))
            if len(lanes):
                to = at - self._width(last[at, lanes])
                marks[at, lanes] = False
                heads[lanes] -= marks[to, lanes]
                marks[to, lanes] = True
        return marks.argmax(axis=0) + base

    def _commit(self, lanes: np.ndarray, tops: np.ndarray, last: np.ndarray, base: int, done: np.ndarray, out: list[bytes]) -> None:
        """Adds the ids between what lanes have committed and `tops`."""
        if not len(lanes):
            return
        width = int((tops - done[lanes]).max())
        ids, at, first = np.zeros((len(lanes), width), "<i4"), tops.copy(), np.full(len(lanes), width)
        live = np.arange(len(lanes))
        while len(live):  # back from each top
            piece = last[at[live] - base, lanes[live]]
            first[live] -= 1
            ids[live, first[live]] = piece
            at[live] -= self._width(piece)
            live = live[at[live] > done[lanes[live]]]
        odd = (ids >= self.count).any(axis=1)
        flat = ids.tobytes()
        for k, (lane, start, own) in enumerate(zip(lanes.tolist(), first.tolist(), odd.tolist())):
            if own:
                out[lane] += packed([b for i in ids[k, start:].tolist() for b in ([i] if i < self.count else [self.m.bytes[x] for x in chr(i - self.count).encode("utf-8", "surrogatepass")])])
            else:
                out[lane] += flat[4 * (k * width + start) : 4 * (k + 1) * width]
        done[lanes] = tops


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def worker_pairs(model: bytes) -> dict:
    """What this process knows of a model's pairs of pieces (a few megabytes): it outlives
    a task where workers are reused, unlike all else."""
    store = sys.modules.setdefault("_fabula_worker", types.ModuleType("_fabula_worker")).__dict__
    return store.setdefault(hashlib.sha256(model).hexdigest(), {})


def decode(model: PieceModel, ids) -> str:
    """The text that encode() was given; invalid bytes become U+FFFD."""
    text = b"".join(map(model.table.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def tokenize(docs: DataFrame, model: bytes) -> DataFrame:
    """Replaces `text` by ids array<int>, n_ids long, ids_sha256 (of the ids as little-
    endian int32), text_sha256 and round_trip boolean (decoding gives the text back;
    null counts as empty). One pass, no shuffle; the model (half a megabyte) travels
    with the code."""
    docs = docs.drop("ids", "n_ids", "ids_sha256", "text_sha256", "round_trip")
    schema = extended(docs, "ids array<int>, n_ids bigint, ids_sha256 string, text_sha256 string, round_trip boolean", ("text",))
    names = schema.names[:-5]

    def make():
        encoder, pairs = Encoder(PieceModel(model)), worker_pairs(model)
        if pairs:
            encoder.streams.known, encoder.streams.valid = pairs["known"], pairs["valid"]

        def handle(part):
            if part.num_rows:
                texts = part.column("text").to_pylist()
                arrays = encoder.encode_all(texts)
                sizes = [len(a) for a in arrays]
                raw = [hashlib.sha256(a.astype("<i4").tobytes()).hexdigest() for a in arrays]
                said = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
                same = [decode(encoder.m, a.tolist()) == (t or "") for a, t in zip(arrays, texts)]
                flat = pa.array(np.concatenate(arrays), pa.int32())
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4"), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.ListArray.from_arrays(ends, flat), pa.array(sizes, pa.int64()), pa.array(raw), pa.array(said), pa.array(same)],
                    names=[*names, "ids", "n_ids", "ids_sha256", "text_sha256", "round_trip"],
                )

        def close():
            pairs.update(known=encoder.streams.known, valid=encoder.streams.valid)
            encoder.__dict__.clear()

        handle.close = close
        return handle

    return arrow_map(docs, make, schema)
