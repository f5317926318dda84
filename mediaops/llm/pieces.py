"""SentencePiece encoding and decoding with N-best segmentation.

Forward Viterbi gives, for every place in a text, the best score of any
segmentation up to it. A* then walks the piece lattice backwards from the end; the
Viterbi scores are its exact heuristic, so segmentations come out best first.

No piece has a space after its first letter, so a text's lattice falls apart in
front of each run of spaces (and around line feeds, which no piece holds). These
chunks are segmented on their own, repeated ones once a task, and a text's N best
segmentations are the N best sums over its chunks. Viterbi goes through many new
chunks at once, a place at a time, as steps on arrays; what ends at a place is told
by an Aho-Corasick automaton of the pieces.
"""

from __future__ import annotations

import heapq
import re
from array import array
from bisect import insort
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
_CHUNK = re.compile(r" +[^ \n]*|\n|[^ \n]+")
_KNOWN, _KNOWN_CHARACTERS = 250_000, 8_000_000  # of the chunks of a generation; a task remembers two of them, an idle worker one
_LONG = 20_000  # characters of a chunk that is cut further, or whose lattice is not held
_FEW = 64  # chunks that must reach a place for a step on arrays to be worth it; those that go on alone take a lattice each
_AT_ONCE = 400_000  # characters of chunks that are segmented at once, at some 60 bytes each
_NEVER, _LOWEST = 1 << 62, -(1 << 62)


class Vocabulary:
    """Pieces and scores of a model file; a space stands for the word mark."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], unknown: int):
        #: pieces from their last character on: character to (next node, (score in millionths, (id,)) or None);
        #: whole numbers add up exactly
        self.trie: dict[str, tuple] = {}
        for i, (p, score) in enumerate(zip(pieces, scores, strict=True)):
            node = self.trie
            for c in p[:0:-1]:
                node = node.setdefault(c, ({}, None))[0]
            if p:
                node[p[0]] = (node[p[0]][0] if p[0] in node else {}, (round(score * 1e6), (i,)))
        self.longest = max(map(len, pieces), default=1)
        self.byte_ids, self.unknown = byte_ids, unknown
        self.fallback = round((min((s for s in scores if s > -1e8), default=0.0) - 10) * 1e6)
        self.bytes = [p.encode() for p in pieces]
        for b, i in byte_ids.items():
            self.bytes[i] = bytes([b])
        self.automaton = _Automaton(pieces, [round(s * 1e6) for s in scores])

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = [], {}
        for i in range(sp.get_piece_size()):
            special = sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)
            pieces.append("" if special else sp.id_to_piece(i).replace("▁", " "))
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("a piece goes on after a space; chunks would cut it")
        return cls(pieces, [sp.get_score(i) for i in range(len(pieces))], byte_ids, sp.unk_id())

    def fall_back(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode()) if self.byte_ids else (self.unknown,)

    def decode(self, ids: list[int]) -> str:
        """The text of piece identifiers, without the space put before every text."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode("utf-8", "replace")


def _runs(begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places from each begin on, as many as its length, one run after the other."""
    after = np.cumsum(lens)
    return np.repeat(begin - (after - lens), lens) + np.arange(after[-1] if len(after) else 0)


class _Automaton:
    """Aho-Corasick automaton of pieces, in arrays by state; state 0 has read nothing that a piece begins with.

    The pieces that end in a state are ``match`` of it, the longest one, ``after`` of
    that, and so on to 0. A piece is named by the state it leads to."""

    def __init__(self, pieces: list[str], scores: list[int]):
        step: dict[int, int] = {}  # state and code point to state
        back, depth, piece = [(0, 0)], [0], [-1]
        for i, p in enumerate(pieces):
            at = 0
            for c in map(ord, p):
                key = at << 21 | c
                if key not in step:
                    step[key] = len(depth)
                    back.append((at, c))
                    depth.append(depth[at] + 1)
                    piece.append(-1)
                at = step[key]
            if p:
                piece[at] = i
        fail, match, after, lone = [0] * len(depth), [0] * len(depth), [0] * len(depth), [False] * len(depth)
        for at in sorted(range(1, len(depth)), key=depth.__getitem__):
            (before, c), to = back[at], 0
            while before and not to:
                before = fail[before]
                to = step.get(before << 21 | c, 0)
            fail[at], after[at] = to, match[to]
            match[at] = at if piece[at] >= 0 else match[to]
            lone[at] = lone[to] if to else depth[at] == 1 and piece[at] >= 0
        #: the state of the longest proper end; whether the last character is a piece
        self.fail, self.match, self.after, self.lone = np.array(fail, np.int32), np.array(match, np.int32), np.array(after, np.int32), np.array(lone)
        self.size, self.piece = np.array([1, *depth[1:]], np.int64), np.array(piece, np.int64)  # state 0 stands for one character without a piece
        self.score = np.array([scores[i] if i >= 0 else 0 for i in piece], np.int64)
        #: the steps as a hash table of four times their number, the next place taken where one is taken already
        self.bits = max(4 * len(step), 2).bit_length()
        self.keys, self.states = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        keys, states = np.array(list(step), np.int64), np.array(list(step.values()), np.int32)
        for slot, key, state in zip(self._slots(keys).tolist(), keys.tolist(), states.tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.states[slot] = key, state

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _child(self, keys: np.ndarray) -> np.ndarray:
        """States that steps lead to, 0 where there is none."""
        slots = self._slots(keys)
        there = self.keys[slots]
        out = self.states[slots]
        open_ = np.flatnonzero(there != keys)
        while len(open_):
            open_ = open_[self.keys[slots[open_]] >= 0]
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.states[slots[open_]]
            open_ = open_[self.keys[slots[open_]] != keys[open_]]
        return out

    def onward(self, states: np.ndarray, points: np.ndarray) -> np.ndarray:
        """States after a code point each."""
        out = self._child(states.astype(np.int64) << 21 | points)
        open_ = np.flatnonzero((out == 0) & (states > 0))
        before = states[open_]
        while len(open_):
            before = self.fail[before]
            out[open_] = self._child(before.astype(np.int64) << 21 | points[open_])
            more = (out[open_] == 0) & (before > 0)
            open_, before = open_[more], before[more]
        return out


def best_paths(vocabulary: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``Lattice.best_path`` of many strings at once: scores, piece identifiers of all, where each string's end, costs of the second best.

    Strings lie longest first, so that those that reach a place are the first ones;
    a row a place holds what ``Lattice.best`` does, the best piece that ends there and
    what the next best piece costs."""
    a, n = vocabulary.automaton, len(texts)
    lens = np.fromiter(map(len, texts), np.int64, n)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    order = np.argsort(-lens, kind="stable")
    begin, lens = (np.cumsum(lens) - lens)[order], lens[order]
    reach = np.searchsorted(-lens, -np.arange(lens[0]), "left")  # strings longer than that
    row = np.concatenate([[0, n], n + np.cumsum(reach)])
    best, piece, cost = np.zeros(row[-1], np.int64), np.zeros(row[-1], np.int32), np.empty(row[-1], np.int64)
    state = np.zeros(n, np.int32)
    for j, m in enumerate(reach.tolist()):
        state = a.onward(state[:m], points[begin[:m] + j])
        top = np.where(a.lone[state], _LOWEST, best[row[j] : row[j] + m] + vocabulary.fallback)
        second, chosen = np.full(m, _LOWEST), np.zeros(m, np.int32)
        at = np.flatnonzero(a.match[state])
        found = a.match[state[at]]
        while len(at):  # from the longest piece on; of equal scores the shortest goes
            score, old = best[row[j + 1 - a.size[found]] + at] + a.score[found], top[at]
            second[at] = np.maximum(second[at], np.minimum(score, old))
            top[at] = np.maximum(score, old)
            chosen[at] = np.where(score >= old, found, chosen[at])
            found = a.after[found]
            more = np.flatnonzero(found)
            at, found = at[more], found[more]
        held = slice(row[j + 1], row[j + 1] + m)
        best[held], piece[held], cost[held] = top, chosen, np.where(second == _LOWEST, _NEVER, top - second)
    who, at, least, taken = np.arange(n), lens.copy(), np.full(n, _NEVER), []
    while len(who):
        k = row[at] + who
        least[who] = np.minimum(least[who], cost[k])
        taken.append((who, np.where(piece[k], a.piece[piece[k]], -1 - points[begin[who] + at - 1])))
        at = at - a.size[piece[k]]
        more = np.flatnonzero(at)
        who, at = who[more], at[more]
    counts, total, costs = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    counts[order], total[order], costs[order] = np.bincount(np.concatenate([w for w, _ in taken]), minlength=n), best[row[lens] + np.arange(n)], least
    ends = np.cumsum(counts)
    ids = np.empty(ends[-1], np.int64)
    for k, (who, value) in enumerate(taken):
        ids[ends[order[who]] - 1 - k] = value
    if ids.min() < 0:  # characters without a piece
        lacking, which = np.unique(-1 - ids[ids < 0], return_inverse=True)
        spelt = [vocabulary.fall_back(chr(c)) for c in lacking.tolist()]
        size, widths = np.ones(len(ids), np.int64), np.array(list(map(len, spelt)))
        size[ids < 0] = widths[which]
        ids[ids < 0] = (len(vocabulary.bytes) + np.cumsum(widths) - widths)[which]
        ids = np.concatenate([np.arange(len(vocabulary.bytes)), *spelt])[_runs(ids, size)]
        ends = np.cumsum(size)[ends - 1]
    return total, ids, ends, costs


class _Edges:
    """The pieces that end at each place of a text, looked up anew each time: for lattices too long to be held."""

    def __init__(self, vocabulary: Vocabulary, text: str):
        self.vocabulary, self.text = vocabulary, text

    def __getitem__(self, at: int) -> list[tuple]:
        node, i, edges, longest = self.vocabulary.trie, at - 1, [], self.vocabulary.longest
        for c in self.text[at - 1 : at - 1 - longest if at > longest else None : -1]:
            step = node.get(c)
            if step is None:
                break
            node, found = step
            if found is not None:
                edges.append((i, found))
            i -= 1
        if not edges or edges[0][0] != at - 1:
            edges.append((at - 1, (self.vocabulary.fallback, self.vocabulary.fall_back(self.text[at - 1]))))
        return edges


def cut_long(vocabulary: Vocabulary, chunk: str, least: int = _LONG // 4) -> list[str]:
    """A long chunk in parts of ``least`` characters or more, cut where no piece lies across: every segmentation passes there.

    Where pieces overlap all the way (one letter over and over), it stays whole."""
    edges, low, cuts = _Edges(vocabulary, chunk), len(chunk), [len(chunk)]
    for j in range(len(chunk), 1, -1):
        low = min(low, min(start for start, _ in edges[j]))
        if low >= j - 1 and cuts[-1] - (j - 1) >= least:
            cuts.append(j - 1)
    bounds = [0, *reversed(cuts)]
    return [chunk[a:b] for a, b in zip(bounds, bounds[1:], strict=False) if b > a]


class Lattice:
    """Piece lattices of strings, one after the other; what a string begins like the one before it is kept.

    ``best[j]`` is the best score of any segmentation of the first j characters,
    ``into[j]`` holds the pieces that end there, with the places they begin at."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.text = vocabulary, ""
        self.best: list[int] = [0]
        self.into: list[list[tuple]] = [[]]

    def forward(self, text: str) -> None:
        """Viterbi from where the text parts from the last one. Of a long text, only scores are held."""
        if len(text) > _LONG:
            self.best, self.into, self.text = array("q", [0]), _Edges(self.vocabulary, text), text
            for j in range(1, len(text) + 1):
                self.best.append(max(self.best[i] + found[0] for i, found in self.into[j]))
            return
        if len(self.text) > _LONG:
            self.best, self.into, self.text = [0], [[]], ""
        old, same = self.text, 0
        for a, b in zip(old, text, strict=False):
            if a != b:
                break
            same += 1
        best, into, trie, longest = self.best, self.into, self.vocabulary.trie, self.vocabulary.longest
        del best[same + 1 :], into[same + 1 :]
        for j in range(same, len(text)):
            node, i, top, edges = trie, j, _LOWEST, []
            for c in text[j : j - longest if j >= longest else None : -1]:
                step = node.get(c)
                if step is None:
                    break
                node, found = step
                if found is not None:
                    edges.append((i, found))
                    score = best[i] + found[0]
                    if score > top:
                        top = score
                i -= 1
            if not edges or edges[0][0] != j:  # no single-character piece
                edges.append((j, (self.vocabulary.fallback, self.vocabulary.fall_back(text[j]))))
                top = max(top, best[j] + self.vocabulary.fallback)
            best.append(top)
            into.append(edges)
        self.text = text

    def best_path(self, text: str) -> tuple[int, list[int], int]:
        """Score (in millionths) and piece identifiers of the best segmentation, and what the second best costs.

        The second best leaves the best path, seen from the end, at one place by
        another piece and is the best from there on."""
        self.forward(text)
        best, into, at = self.best, self.into, len(text)
        pieces: list[tuple[int, ...]] = []
        cost = _NEVER
        while at:
            top, onward = best[at], None
            for start, found in into[at]:
                gap = top - best[start] - found[0]
                if gap == 0 and onward is None:
                    onward = start
                    pieces.append(found[1])
                elif gap < cost:
                    cost = gap
            at = onward
        return best[len(text)], [i for piece in reversed(pieces) for i in piece], cost

    def n_best(self, text: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best segmentations of a string, as (score in millionths, piece identifiers), best first.

        A character that no single-character piece covers also has the byte pieces of
        its UTF-8 form, at ten less than the lowest score. A* goes from the end to the
        start; each open state's estimate is the score of some segmentation of its own,
        so no more states than segmentations still wanted are kept open. Of equal
        scores, the state nearer to the start goes first."""
        self.forward(text)
        best, into, size = self.best, self.into, len(text)
        out: list[tuple[int, tuple[int, ...]]] = []
        pushed, room = 0, n - 1
        open_: list[tuple] = [(-best[size], size, 0, 0, None)]
        while open_ and room >= 0:
            key, at, _, done, path = open_.pop(0)
            while at:
                onward = None
                for start, found in into[at]:
                    so_far = done + found[0]
                    estimate = -(best[start] + so_far)
                    if estimate == key and onward is None:
                        onward = (start, so_far, (found[1], path))  # as good as any open state: expanded next
                    elif room:
                        if len(open_) >= room:
                            last = open_[-1]
                            if estimate > last[0] or (estimate == last[0] and start >= last[1]):
                                continue
                            open_.pop()
                        pushed += 1
                        insort(open_, (estimate, start, pushed, so_far, (found[1], path)))
                at, done, path = onward
            ids: list[int] = []
            while path is not None:
                piece, path = path
                ids.extend(piece)
            out.append((done, tuple(ids)))
            room -= 1
            del open_[max(room + 1, 0) :]
        return out


def n_best(text: str, vocabulary: Vocabulary, n: int) -> list[tuple[int, tuple[int, ...]]]:
    return Lattice(vocabulary).n_best(text, n)


def _choices(total: int, costs: list[tuple[int, ...]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n largest sums when each list may give another than its best score, at these costs (0 first), and what each list gives."""
    made = ((total - sum(c[i] for c, i in zip(costs, o, strict=True)), o) for o in product(*(range(len(c)) for c in costs)))
    return heapq.nlargest(n, made, key=lambda x: x[0])


class _Chunks(dict):
    """Numbers of chunks that have been segmented.

    What a number stands for lies in flat arrays: piece identifiers, best score, what
    the second best costs, and whether decoding gives the chunk again. Chunks of the
    generation before are taken over when they occur again; the rest go."""

    def __init__(self, model: Vocabulary, n: int, before: _Chunks | None = None):
        super().__init__()
        self.model, self.n, self.lattice = model, n, Lattice(model)
        self.before = before
        if before is not None:
            before.before = None
        self.ids, self.ends, self.best, self.costs = array("i"), array("q", [0]), array("q"), array("q")
        self.exact, self.characters = bytearray(), 0
        #: the n best segmentations of chunks that gave a text's next best ones
        self.found: dict[str, list[tuple[int, tuple[int, ...]]]] = {}

    def learn(self, texts: list[list[str]]) -> None:
        """Take over or segment what is new: most at once, the few longest in order, so that neighbours begin alike."""
        new, old = set().union(*texts).difference(self), self.before
        if old is not None:
            known = list(new.intersection(old))
            at = np.fromiter(map(old.__getitem__, known), np.int64, len(known))
            ends = np.frombuffer(old.ends, np.int64)
            lens = ends[at + 1] - ends[at]
            ids, best, costs, exact = (np.frombuffer(x, t) for x, t in ((old.ids, np.int32), (old.best, np.int64), (old.costs, np.int64), (old.exact, np.uint8)))
            self.add(known, best[at], ids[_runs(ends[at], lens)], np.cumsum(lens), costs[at], exact[at].tobytes())
            new.difference_update(known)
        for some in _some(sorted(new, key=len), _AT_ONCE):
            rest = max(len(some) - _FEW + 1, 0)
            while 0 < rest < len(some) and len(some[rest]) == len(some[rest - 1]):
                rest += 1
            if rest:
                self.check(some[:rest], *best_paths(self.model, some[:rest]))
            for text in sorted(some[rest:]):
                top, ids, cost = self.lattice.best_path(text)
                self.check([text], np.array([top]), np.array(ids), np.array([len(ids)]), np.array([cost]))

    def check(self, texts: list[str], best: np.ndarray, ids: np.ndarray, ends: np.ndarray, costs: np.ndarray) -> None:
        """Add segmented chunks, with whether they decode."""
        spelt = list(map(self.model.bytes.__getitem__, ids.tolist()))
        bounds = [0, *ends.tolist()]
        exact = bytes(b"".join(spelt[a:b]) == text.encode() for text, a, b in zip(texts, bounds, bounds[1:], strict=False))
        self.add(texts, best, ids, ends, costs, exact)

    def add(self, texts: list[str], best: np.ndarray, ids: np.ndarray, ends: np.ndarray, costs: np.ndarray, exact: bytes) -> None:
        first, base = len(self.best), len(self.ids)
        self.ids.frombytes(ids.astype(np.int32).tobytes())
        for held, values in ((self.ends, ends + base), (self.best, best), (self.costs, costs)):
            held.frombytes(values.astype(np.int64).tobytes())
        self.exact.extend(exact)
        self.characters += sum(map(len, texts))
        self.update(zip(texts, range(first, first + len(texts)), strict=True))

    def n_best(self, chunk: str) -> list[tuple[int, tuple[int, ...]]]:
        if chunk not in self.found:
            self.found[chunk] = self.lattice.n_best(chunk, self.n)
        return self.found[chunk]

    def text(self, chunks: list[str]) -> tuple[np.ndarray, list[float], list[list[tuple]], bool]:
        """Piece identifiers, the n best scores, what the second to n-th best change, and whether decoding is exact, for a text's chunks."""
        at = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        ends = np.frombuffer(self.ends, np.int64)
        lens = ends[at + 1] - ends[at]
        after = np.cumsum(lens)
        ids = np.frombuffer(self.ids, np.int32)[_runs(ends[at], lens)]
        few: list[int] = []
        if self.n > 1:  # only the n - 1 chunks whose second best costs least can matter
            second = np.frombuffer(self.costs, np.int64)[at]
            few = sorted((np.argpartition(second, self.n - 2)[: self.n - 1] if len(at) >= self.n else np.arange(len(at))).tolist())
        made = [self.n_best(chunks[i]) for i in few]
        total = int(np.frombuffer(self.best, np.int64)[at].sum())
        best = _choices(total, [tuple(x[0][0] - score for score, _ in x) for x in made], self.n)
        changes = [[(int(after[i] - lens[i]), int(after[i]), x[rank][1]) for i, x, rank in zip(few, made, o, strict=True) if rank] for _, o in best[1:]]
        return ids, [x / 1e6 for x, _ in best], changes, bool(np.frombuffer(self.exact, np.uint8)[at].all())


_held: _Chunks | None = None


def _chunks(model: Vocabulary, n: int) -> _Chunks:
    """The chunks that this worker remembers, over its tasks, up to a bound."""
    global _held
    if _held is None or _held.model is not model or _held.n != n:
        _held = _Chunks(model, n)
    elif len(_held) > _KNOWN or _held.characters > _KNOWN_CHARACTERS:
        _held = _Chunks(model, n, _held)
    return _held


def _rest() -> None:
    """After a task: its worker may stay idle or do other work, and holds one generation of chunks meanwhile."""
    if _held is not None:
        _held.before, _held.lattice = None, Lattice(_held.model)
        _held.found.clear()


def _some(texts: list[str | None], size: int = 2_000_000) -> Iterator[list[str | None]]:
    """Texts in order, about ``size`` characters at a time."""
    held, total = [], 0
    for x in texts:
        held.append(x)
        total += len(x or "")
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def encode(docs: DataFrame, vocabulary: Vocabulary, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, token_ids, n_tokens, scores, round_trip, others.

    token_ids is the best segmentation of the whole text with a space before it,
    scores those of the n best (fewer where there are fewer). others has an entry for
    each of these but the best: an array of begin, end, ids, the pieces that stand
    in place of token_ids from begin to end; ``segmentations`` spells them out.
    round_trip tells whether decoding token_ids gives the text again; with byte
    pieces it always does. Null and empty texts have no tokens and the score 0.
    Segmentations of equal score come in the order that the search meets them, the
    same each time. A null identifier stays null; repeated rows are encoded each; an
    empty table gives no rows; further columns are ignored. Whole texts are encoded; of a very long one, a task
    holds its pieces. An unbroken run of any length is cut where no piece lies across, and where
    there is no such place only its scores are held (under 100 bytes a character)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the model file, whatever the corpus is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from encoded(batches)
        finally:
            _rest()

    def chunks_of(text: str | None) -> list[str]:
        found = _CHUNK.findall(" " + text) if text else []
        if text and max(map(len, found)) > _LONG:
            found = [part for c in found for part in (cut_long(shared.value, c) if len(c) > _LONG else (c,))]
        return found

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lens, scores, others, same = [np.empty(0, np.int32)], [], [], [], []
            for texts in _some(b.column("text").to_pylist()):
                known = _chunks(shared.value, n)
                cut = list(map(chunks_of, texts))
                known.learn(cut)
                for chunks in cut:
                    own, best, changes, exact = known.text(chunks) if chunks else (ids[0][:0], [0.0], [], True)
                    ids.append(own)
                    lens.append(len(own))
                    scores.append(best)
                    others.append(changes)
                    same.append(exact)
            flat = pa.array(np.concatenate(ids))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
            yield pa.record_batch(
                {"doc_id": b.column("doc_id"), "token_ids": pa.ListArray.from_arrays(offsets, flat), "n_tokens": pa.array(lens, pa.int32()), "scores": pa.array(scores, pa.list_(pa.float64())),
                 "round_trip": pa.array(same, pa.bool_()), "others": _change_lists(others)}
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, token_ids array<int>, n_tokens int, scores array<double>, round_trip boolean, others {OTHERS}")


OTHERS = "array<array<struct<begin:int,end:int,ids:array<int>>>>"


def _change_lists(others: list[list[list[tuple]]]) -> pa.Array:
    """others as nested lists, from flat ones."""

    def ends(sizes: list[int]) -> pa.Array:
        return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))

    ranks = [changes for row in others for changes in row]
    flat = [x for changes in ranks for x in changes]
    ids = pa.ListArray.from_arrays(ends([len(x[2]) for x in flat]), pa.array([i for x in flat for i in x[2]], pa.int32()))
    one = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), ids], ["begin", "end", "ids"])
    return pa.ListArray.from_arrays(ends([len(x) for x in others]), pa.ListArray.from_arrays(ends([len(x) for x in ranks]), one))


def segmentations(token_ids: list[int], others: list[list[tuple[int, int, list[int]]]]) -> list[list[int]]:
    """A row's n best segmentations in full, the best first."""
    out = [list(token_ids)]
    for changes in others:
        own = list(token_ids)
        for begin, end, ids in reversed(changes):
            own[begin:end] = ids
        out.append(own)
    return out


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, text of rows with doc_id and token_ids; null or no tokens give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [shared.value.decode(x or []) for x in b.column("token_ids").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").mapInArrow(run, "doc_id long, text string")


def op7_sentencepiece(spark, sf_dir: str, model: str = MODEL) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), Vocabulary.read(model))
