"""SentencePiece encoding and decoding: k segmentations of a text, drawn without replacement by perturbed A-star search.

Every piece has a log-probability, and a text's lattice of pieces a distribution over whole segmentations. Each segmentation's
log-probability is perturbed with Gumbel noise and the k largest win. The search never lists segmentations: a node
stands for all that share a beginning, its value is the largest perturbed value among them, and a child's value is drawn under the
condition that the parent's is the largest (Maddison, Tarlow and Minka 2014). Walking down from the best node emits a
segmentation and leaves one node for all that parts from it at some step. The best of these nodes is the next to walk down from;
only then are the step and the way drawn by their masses, and what is left of the node gets a new value.

Words are lattices of their own, as no piece goes beyond a word. numpy works out the lattices of a batch's distinct words
and walks all its words at once. Noise comes from a hash of the row's seed and the place in its text, so a row's
samples depend on its key and text alone.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import trim_memory
from keyweave.workers import ship

#: With two, the second always leaves the first's path; with eight, 99 % of texts walk down from another path too.
SAMPLES = 8
SPACE = "▁"
#: Log-probability that an unknown character costs beyond the rarest piece.
UNKNOWN = 10.0
#: Longer pieces with lower scores are never made by the model itself.
_UNUSED = -1e8
#: Characters of the texts of a search, and of those that share their words' lattices.
_CHARS = 1 << 20
_SHARED = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARKS = ".,;:!?|%$#*&"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def uniform_bits(seed: np.ndarray, *place: np.ndarray | int) -> np.ndarray:
    x = seed
    for p in place:
        x = _mix(x + _BASE * (np.atleast_1d(p).astype(np.uint64) + np.uint64(1)))
    return x


def uniform(seed: np.ndarray, *place: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) from a seed and places."""
    x = uniform_bits(seed, *place)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Pieces:
    """The pieces of a model with log-probabilities. Those of a BPE model, which has ranks only, fall as 1 / (rank + 2.7)."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        own = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and (sp.get_score(i) > _UNUSED or len(self.text[i]) == 1)]
        self.byte = {int(self.text[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        rank = np.arange(len(own))
        score = np.array([sp.get_score(i) for i in own])
        used = score > _UNUSED
        score[~used] = score[used].min()
        by_rank = bool(np.all(np.diff(score[used]) <= 0) and np.all(score == np.round(score)))
        log_p = -np.log(rank + 2.7) if by_rank else score
        self.log_p = np.full(n + 1, log_p.min() - UNKNOWN)  # the last is for characters without a piece
        self.log_p[own] = log_p - (np.log(np.exp(log_p).sum()) if by_rank else 0)
        self.log_p[-1] = self.log_p[own].min() - UNKNOWN
        self.log_p[list(self.byte.values())] = self.log_p[-1]
        self.longest = max(len(self.text[i]) for i in own)
        entry: dict[int, int] = {}
        for i in own:
            h = 0
            for c in self.text[i]:
                h = (h + ord(c) + 1) * int(_BASE) & 0xFFFFFFFFFFFFFFFF
                entry.setdefault(h, -1)  # a beginning of a piece
            entry[h] = i
        for b, i in self.byte.items():
            if b < 128:
                entry.setdefault((b + 1) * int(_BASE) & 0xFFFFFFFFFFFFFFFF, i)
        keys = np.array(list(entry), dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(entry.values()), dtype=np.int32)[order]
        inside = {(a, b) for i in own for a, b in zip(self.text[i], self.text[i][1:])}
        self.marks = "".join(m for m in _MARKS if not any(b == m and a.isalpha() for a, b in inside))
        self.lines = not any("\n" in p for p in inside)
        self.out = [b"" if sp.is_control(i) else bytes([int(t[3:-1], 16)]) if sp.is_byte(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]
        self.bytes = np.frombuffer(b"".join(self.out), dtype=np.uint8)
        self.size = np.array([len(x) for x in self.out])
        self.begin = np.cumsum(self.size) - self.size
        self.taken = pa.array(self.out, pa.large_binary())
        self.slots = self._table()

    def _table(self) -> np.ndarray:
        """Where in keys the hashes with the same 20 leading bits begin."""
        return np.searchsorted(self.keys >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash; -1 for a mere beginning, -2 for none."""
        top = (h >> np.uint64(44)).astype(np.int64)
        at, end = self.slots[top], self.slots[top + 1]
        out = np.full(len(h), -2, dtype=np.int32)
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = self.keys[at] == h[left]
            out[left[hit]] = self.ids[at[hit]]
            at = at + 1
            go = ~hit & (at < end)
            left, at, end = left[go], at[go], end[go]
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of piece ids, without the space that encoding put first."""
        ids = np.asarray(ids, dtype=np.int64)
        n = self.size[ids]
        at = np.arange(n.sum()) + np.repeat(self.begin[ids] - (np.cumsum(n) - n), n)
        return self.bytes[at].tobytes().removeprefix(b" ").decode("utf-8", "replace")

    def decoded(self, ids: np.ndarray, ends: np.ndarray, texts: list[str]) -> np.ndarray:
        """Whether the ids between ends decode to each text."""
        got = self.taken.take(pa.array(ids))
        at = np.frombuffer(got.buffers()[1], dtype=np.int64)[ends] if len(ids) else ends
        data, cut = got.buffers()[2].to_pybytes() if len(ids) else b"", at.tolist()
        first = [i + data.startswith(b" ", i, j) for i, j in zip(cut, cut[1:])]
        return np.array([j - i == len(t) and data.startswith(t, i) for i, j, t in zip(first, cut[1:], map(str.encode, texts))], dtype=bool)


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattices:
    """Lattices of words. Words are ranked by falling length, and a node is a place of a word, numbered by its distance from
    the word's end and then by rank, so that the pieces that begin at a distance lie side by side and lead to earlier nodes."""

    def __init__(self, p: Pieces, words: pa.StringArray) -> None:
        size = pc.utf8_length(words).to_numpy().astype(np.int64)
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        size = size[order]
        many = np.searchsorted(-size, -np.arange(int(size.max(initial=0)) + 1), side="right")  # words of at least this length
        base = np.concatenate([[0], np.cumsum(many)])
        n = int(base[-1])
        far = np.repeat(np.arange(len(many)), many)  # distance of each node from its word's end
        self.first = (base[size] + np.arange(len(words)))[rank]
        flat = words.take(pa.array(order)).cast(pa.large_string()).buffers()[2] if len(words) else None
        flat = np.frombuffer((flat.to_pybytes() if flat else b"").decode().encode("utf-32-le"), dtype=np.uint32)
        self.code = code = np.zeros(n, dtype=np.uint64)
        spot = np.repeat(size, size) - (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size))
        code[base[spot] + np.repeat(np.arange(len(words)), size)] = flat
        closed = int(many[0]) if len(many) else 0  # nodes at words' ends
        behind = base[far - 1] + np.arange(n) - base[far]  # each node's next place
        live = np.arange(closed, n)
        h, place, unknown = np.zeros(len(live), dtype=np.uint64), live, len(p.log_p) - 1
        ways, found = np.zeros(n, dtype=np.int64), []
        for k in range(p.longest):
            h = (h + code[place] + np.uint64(1)) * _BASE
            if k:
                got = ids = p.find(h)
            else:  # by characters, of which there are few
                char = np.flatnonzero(np.bincount(flat)) if len(flat) else np.empty(0, dtype=np.int64)
                known = np.empty(int(char[-1]) + 1 if len(char) else 0, dtype=np.int32)
                known[char] = p.find((char.astype(np.uint64) + np.uint64(1)) * _BASE)
                got = known[code[place].astype(np.int64)]
                ids = np.where(got < 0, unknown, got)
            place = behind[place]
            ok = np.flatnonzero(ids >= 0)
            at = live[ok]
            found.append((at, ways[at], ids[ok], place[ok]))
            ways[at] += 1
            go = np.flatnonzero((got != -2) & (place >= closed))
            live, h, place = live[go], h[go], place[go]
            if not len(live):
                break
        self.ways, self.start = ways, np.cumsum(ways) - ways  # start: first way of each node
        self.ids, to = np.empty(ways.sum(), dtype=np.int32), np.empty(ways.sum(), dtype=np.int64)
        last = self.start + ways - 1  # by node, then falling length, so that the likeliest ways mostly come first
        while found:
            at, nth, ids, place = found.pop()
            way = last[at] - nth
            self.ids[way], to[way] = ids, place
        node = np.repeat(np.arange(n, dtype=np.int32), ways)
        self.node = node  # where each way begins
        self.nth = (np.arange(len(node)) - np.repeat(self.start, ways)).astype(np.int8)  # and its number there
        self.free = np.repeat(ways > 1, ways)  # the ways beside which there are others
        self.next = np.where(to >= closed, self.start[to], -1)  # the first way behind each, -1 at a word's end
        self.log_p = p.log_p  # of all pieces
        log_q, q, back = p.log_p[self.ids], np.empty(len(node)), np.zeros(n)
        edge = np.append(self.start, len(node))[base]  # first way at each distance
        for r in range(1, len(many)):
            e, f = int(edge[r]), int(edge[r + 1])
            v = log_q[e:f] + back[to[e:f]]
            cut, size = self.start[base[r] : base[r + 1]] - e, ways[base[r] : base[r + 1]]
            top = np.maximum.reduceat(v, cut)
            share = np.exp(v - np.repeat(top, size))
            total = np.add.reduceat(share, cut)
            back[base[r] : base[r + 1]] = top = top + np.log(total)
            log_q[e:f] = v - np.repeat(top, size)
            q[e:f] = share / np.repeat(total, size)
        self.log_q, self.log_z = log_q, back
        self.bar = self._bars(q)

    def _bars(self, q: np.ndarray) -> np.ndarray:
        """The largest 64 random bits with which each way is drawn, ways before it aside."""
        bar, at = np.full(len(q), np.iinfo(np.uint64).max), np.flatnonzero(self.ways > 1)
        left, way, total = self.ways[at], self.start[at], np.zeros(len(at))
        while len(way):
            total += q[way]
            bar[way] = np.minimum(total * 2.0**64, 2.0**64 - 2048).astype(np.uint64)
            go = np.flatnonzero(left > 2)
            left, way, total = left[go] - 1, way[go] + 1, total[go]
        return bar

    def choose(self, way: np.ndarray, bits: np.ndarray, bar: np.ndarray) -> np.ndarray:
        """The ways that are drawn at nodes, whose first ways are given, and their bars; nothing is above a last way's bar."""
        left = np.flatnonzero(bits > bar)
        way, bits = way.copy(), bits[left]
        at = way[left]
        while len(left):
            at += 1
            way[left] = at
            go = np.flatnonzero(bits > self.bar[at])
            left, bits, at = left[go], bits[go], at[go]
        return way


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its size, one range behind the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the stretches of x between ends."""
    out, have = np.zeros(len(ends) - 1), np.flatnonzero(np.diff(ends))
    if len(have):
        out[have] = np.add.reduceat(x, ends[have])
    return out


class Path:
    """A segmentation of every text of a batch: its ways in order, and the value of all that leaves it.

    The steps at which a text's may be left are its window; their masses are those below the step from which the path is new.
    """

    def __init__(self, way: np.ndarray, stop: np.ndarray, begin: np.ndarray) -> None:
        """stop: the step after each word, 0 before the first; begin: the first word of each text, and the end."""
        self.way, self.stop = way, stop
        self.ends = stop[begin]  # first step of each text, and the end
        self.cut = np.zeros(len(begin), dtype=np.int64)  # first place of each text in its window, and the end
        self.used, self.mass = np.empty(0, dtype=np.int64), np.empty(0)


class Search:
    """Perturbed A-star search over all texts of a batch at once.

    All that leaves one path is one node, as only its largest value matters. When that is the best, the step and the way at which
    it leaves are drawn by their masses; what still leaves elsewhere has a new value below it.
    """

    #: How far a text's paths fall in a window at first, about; a window is widened when a draw leads behind it.
    _FALL = 16.0

    def __init__(self, lattices: Lattices, words: np.ndarray, text: np.ndarray, texts: int, seed: np.ndarray) -> None:
        """words: the lattice of each word in order; text: whose it is; seed: of each text."""
        self.l, self.text, self.seed, self.texts = lattices, text, seed, texts
        node = lattices.first[words]
        self.way = lattices.start[node]  # the first way of each word
        self.begin = np.searchsorted(text, np.arange(texts + 1))
        self.place = _BASE * (np.arange(len(words)) - self.begin[text] + 1).astype(np.uint64)  # of a word in its text
        self.bar = lattices.bar[self.way]
        self.log_z = _sums(lattices.log_z[node], self.begin)
        self.paths: list[Path] = []
        self.value = [-np.log(-np.log(uniform(seed, 0)))]  # of the segmentations found, by text; the root's mass is 1
        self.here = [np.ones(texts, dtype=bool)]
        none = np.empty(0, dtype=np.int64)
        path = self._walk(np.ones(len(words), dtype=bool), none, none, none, np.zeros(len(words), dtype=np.int32), 0)
        self._add(path, path.ends[:-1], np.zeros(texts), 0)

    def _walk(self, fresh: np.ndarray, word: np.ndarray, way: np.ndarray, nth: np.ndarray, count: np.ndarray, turn: int) -> Path:
        """A path with new ways for all fresh words, and for others from their nth way on, which is given; count: the ways of the rest, to be filled in."""
        seed, steps, level, following = uniform_bits(self.seed, 1, turn), [], 0, self.l.next
        count[fresh] = count[word] = 1
        bits = _mix(np.repeat(seed, np.diff(self.begin)) + self.place)
        first = self.l.choose(self.way, bits, self.bar)
        after, more = following[first], np.flatnonzero(following[way] >= 0)
        go = np.flatnonzero((after >= 0) & fresh)
        at, after = np.concatenate([go, word[more]]), np.concatenate([after[go], following[way[more]]])
        bits = np.concatenate([bits[go], _mix(seed[self.text[word[more]]] + self.place[word[more]])])
        while len(at):
            level += 1
            bits = _mix(bits + _BASE)
            last = self.l.choose(after, bits, self.l.bar[after])
            steps.append((at, last))
            count[at] = level + 1
            after = following[last]
            go = np.flatnonzero(after >= 0)
            at, after, bits = at[go], after[go], bits[go]
        count[word] += nth
        stop = np.zeros(len(count) + 1, dtype=np.int64)
        np.cumsum(count, out=stop[1:])
        begin = stop[:-1].copy()
        begin[word] += nth
        out = np.empty(int(stop[-1]), dtype=np.int64)
        out[begin[fresh]], out[begin[word]] = first[fresh], way
        for level, (at, last) in enumerate(steps, 1):
            out[begin[at] + level] = last
        return Path(out, stop, self.begin)

    def _add(self, path: Path, new: np.ndarray, base: np.ndarray, turn: int) -> None:
        """Draws the value of what leaves a path. new: the step of each text from which the path is new; base: the log-probability of those before."""
        path.new, path.base, path.ids = new, base, self.l.ids[path.way]
        path.total = _sums(self.l.log_p[path.ids], path.ends) - np.where(self.here[turn], self.log_z, 0.0)
        path.rest = np.full(self.texts, -np.inf)
        if not turn:
            self.window = np.clip(self._FALL * np.diff(path.ends) / np.maximum(-path.total, 1e-3), 32, 1 << 20).astype(np.int64)
        path.size = self.window.copy()
        self._window(path)
        self._rest(path, np.arange(self.texts), _sums(path.mass, path.cut) + path.tail, self.value[turn], uniform(self.seed, 2, turn))
        self.paths.append(path)

    def _window(self, path: Path) -> None:
        """The steps from which a path may be left, with their masses, and the mass of all later ones; keeps what is used."""
        left = path.ends[1:] - path.new
        while True:
            size = np.minimum(left, path.size)
            at, cut = _ranges(path.new, size), np.append(0, np.cumsum(size))
            own = path.way[at]
            q = self.l.log_q[own]
            fall = np.append(0, np.cumsum(q))
            end = fall[cut[1:]] - fall[cut[:-1]]  # of the first step behind the window
            later = path.total - path.base - end
            close = (size < left) & (later > -1e-6)  # only rounding may be left
            if not close.any():
                break
            path.size[close] = left[close]
        free, before, used, mass = self.l.free[own], np.diff(path.cut), path.used, path.mass
        path.at, path.own, path.cut = at, own, cut
        path.log_b = fall[:-1] - np.repeat(fall[cut[:-1]], size)
        path.used = np.int64(1) << self.l.nth[own]
        path.mass = np.where(free, np.exp(path.log_b) * np.maximum(-np.expm1(q), 1e-15), 0.0)
        stay = _ranges(cut[:-1], before)
        path.used[stay], path.mass[stay] = used, mass
        path.tail = np.where(size < left, np.exp(end) * -np.expm1(np.minimum(later, 0.0)), 0.0)

    def _rest(self, path: Path, mine: np.ndarray, mass: np.ndarray, value: np.ndarray, noise: np.ndarray) -> None:
        """The largest value that is left on a path for texts, below the one that went; mass: of what is left."""
        with np.errstate(divide="ignore"):
            mass = path.base[mine] + np.log(mass)
        some = mass > -np.inf
        path.rest[mine] = -np.inf
        path.rest[mine[some]] = -np.logaddexp(-value[some], np.log(-np.log(noise[some])) - mass[some])

    def _left(self, node: np.ndarray, used: np.ndarray) -> np.ndarray:
        """The probabilities of the ways of nodes that are not used, [node, way]."""
        k = np.arange(int(self.l.ways[node].max(initial=1)))
        at = np.minimum(self.l.start[node][:, None] + k, len(self.l.log_q) - 1)
        return np.where((k < self.l.ways[node][:, None]) & (used[:, None] >> k & 1 == 0), np.exp(self.l.log_q[at]), 0.0)

    def front(self) -> tuple[np.ndarray, np.ndarray]:
        """The largest value still to be walked down from, by text, and its path."""
        v = np.stack([p.rest for p in self.paths])
        return v.max(axis=0), v.argmax(axis=0)

    def _leave(self, path: Path, mine: np.ndarray, value: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Where texts leave a path (a place of its windows), and by which way; both are used from then on."""
        u = uniform(self.seed[mine], 3, turn)
        while True:
            size = np.diff(path.cut)[mine]
            span, ends = _ranges(path.cut[mine], size), np.append(0, np.cumsum(size))
            inside = _sums(path.mass[span], ends)
            goal = u * (inside + path.tail[mine])
            far = mine[(goal >= inside) & (path.tail[mine] > 0)]
            if not len(far):
                break
            path.size[far] *= 8
            self._window(path)
        total = np.append(0, np.cumsum(path.mass[span] / np.repeat(inside, size)))
        at = np.searchsorted(total[1:], total[ends[:-1]] + goal / inside, side="right")
        some = np.flatnonzero(path.mass[span] > 0)  # rounding never leads to a step that cannot be left, or to another text
        at = span[some[np.minimum(np.searchsorted(some, at), np.searchsorted(some, ends[1:]) - 1)]]
        node = self.l.node[path.own[at]]
        p = self._left(node, path.used[at])
        cum = np.cumsum(p, axis=1)
        u = uniform(self.seed[mine], 4, turn) * cum[:, -1]
        nth = np.minimum((cum <= u[:, None]).sum(axis=1), p.shape[1] - 1 - np.argmax(p[:, ::-1] > 0, axis=1))
        path.used[at] |= np.int64(1) << nth
        path.mass[at] = np.exp(path.log_b[at]) * self._left(node, path.used[at]).sum(axis=1)
        self._rest(path, mine, _sums(path.mass[span], ends) + path.tail[mine], value[mine], uniform(self.seed[mine], 5, turn))
        return at, self.l.start[node] + nth

    def more(self) -> None:
        """The next segmentation of every text that has one."""
        value, whose = self.front()
        turn, here = len(self.paths), np.isfinite(value)
        count = np.zeros(len(self.way), dtype=np.int32)
        cut = np.full(self.texts, np.iinfo(np.int64).max)  # the word in which a text leaves
        base, steps = np.zeros(self.texts), np.zeros(self.texts, dtype=np.int64)
        words, ways, nths = ([np.empty(0, dtype=np.int64)] for _ in range(3))
        copies = []
        for r, path in enumerate(self.paths):
            mine = np.flatnonzero(here & (whose == r))
            if not len(mine):
                continue
            at, way = self._leave(path, mine, value, turn)
            step = path.at[at]
            w = np.searchsorted(path.stop[1:], step, side="right")
            base[mine] = path.base[mine] + path.log_b[at] + self.l.log_q[way]
            before = _ranges(self.begin[mine], w - self.begin[mine])
            count[before] = path.stop[before + 1] - path.stop[before]
            cut[mine], steps[mine] = w, step - path.ends[mine] + 1
            copies.append((mine, path.way[_ranges(path.ends[mine], steps[mine] - 1)]))
            for into, x in ((words, w), (ways, way), (nths, step - path.stop[w])):
                into.append(x)
        word, way, nth = (np.concatenate(x) for x in (words, ways, nths))
        fresh = np.arange(len(self.way)) > np.repeat(cut, np.diff(self.begin))
        path = self._walk(fresh, word, way, nth, count, turn)
        for mine, kept in copies:
            path.way[_ranges(path.ends[mine], steps[mine] - 1)] = kept
        self.value.append(np.where(here, value, -np.inf))
        self.here.append(here)
        self._add(path, path.ends[:-1] + steps, base, turn)


def split_words(p: Pieces, texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct words, the word at each place, and whose place it is. Every space begins a word; so do line ends, and marks after a letter."""
    s = pa.array([SPACE + t.replace(" ", " " + SPACE) if t else "" for t in texts], pa.string())
    if p.lines:
        s = pc.replace_substring(s, "\n", " \n ")
    if p.marks:
        s = pc.replace_substring_regex(s, rf"(\pL)([{''.join('\\' + m for m in p.marks)}])", r"\1 \2")
    split = pc.split_pattern(s, " ")
    coded = split.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy(), coded.dictionary
    text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    full = pc.binary_length(words).to_numpy() > 0
    ok = np.flatnonzero(full[code]) if len(code) else code
    return words.filter(pa.array(full)), (np.cumsum(full) - 1)[code[ok]], text[ok]


def searches(p: Pieces, texts: list[str], seeds: np.ndarray, k: int) -> Iterator[tuple[int, Search]]:
    """Searches for k segmentations of each text, done, each with the number of its first text. Several share lattices."""
    ends = np.cumsum([0, *map(len, texts)])
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + _SHARED, side="right")) - 1)
        distinct, words, text = split_words(p, texts[start:stop])
        lattices = Lattices(p, distinct)
        while start < stop:
            last = min(stop, max(start + 1, int(np.searchsorted(ends, ends[start] + _CHARS))))
            end = int(np.searchsorted(text, last - start))
            out = Search(lattices, words[:end], text[:end], last - start, seeds[start:last])
            for _ in range(k - 1):
                out.more()
            yield start, out
            del out  # before the next is made
            words, text, start = words[end:], text[end:] - (last - start), last
        del lattices


def segmentations(p: Pieces, found: Search) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each rank the texts that have such a segmentation, its log-probabilities, perturbed values, inclusion scores, piece ids and
    the first of these of each text, and the end.

    The inclusion score is the probability that the segmentation's value exceeds the (k + 1)th largest one, 1 if there is none.
    """
    bar, _ = found.front()
    for turn, path in enumerate(found.paths):
        ids, ends = path.ids, path.ends
        odd = np.flatnonzero(ids == len(p.log_p) - 1)
        if len(odd):  # unknown characters are bytes
            code, which = np.unique(found.l.code[found.l.node[path.way[odd]]], return_inverse=True)
            as_bytes = [[p.byte.get(b, p.unknown) for b in chr(int(c)).encode("utf-8", "surrogatepass")] for c in code]
            size = np.ones(len(ids), dtype=np.int64)
            size[odd] = np.array([len(x) for x in as_bytes])[which]
            place = np.cumsum(size) - size
            ids, ends = np.repeat(ids, size), np.append(place, size.sum())[ends]
            ids[_ranges(place[odd], size[odd])] = np.concatenate([as_bytes[i] for i in which.tolist()])
        here = np.flatnonzero(found.here[turn])
        with np.errstate(over="ignore"):
            score = np.where(np.isfinite(bar), -np.expm1(-np.exp(np.minimum(50.0, path.total - bar))), 1.0)
        yield here, path.total[here], found.value[turn][here], score[here], ids, np.append(ends[here], ends[-1])


def encode(p: Pieces, texts: list[str], seeds: np.ndarray, k: int) -> Iterator[tuple[int, int, float, float, float, np.ndarray]]:
    """(text, rank from 1, log-probability, perturbed value, inclusion score, piece ids) of k segmentations of each text."""
    for start, found in searches(p, texts, seeds, k):
        for turn, (here, total, value, score, ids, ends) in enumerate(segmentations(p, found), 1):
            for j, i in enumerate((here + start).tolist()):
                yield i, turn, float(total[j]), float(value[j]), float(score[j]), ids[ends[j] : ends[j + 1]]


def sample(docs: DataFrame, k: int = SAMPLES, path: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """key, sample, n_pieces, log_prob, perturbed, inclusion and ids of k distinct segmentations of every text, best first.

    Without ids: their CRC32 (of little-endian 32-bit words) and whether they decode to the text. A text with fewer than k
    segmentations gives as many rows as it has; null text counts as empty, which has one, of no piece. The character U+2581 is
    read as a space. Rows with equal keys and texts draw equal samples; null keys are one key.
    """
    path = path or model_path()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            texts, seeds = b.column(1).to_pylist(), b.column(2).to_numpy().view(np.uint64)
            for start, found in searches(p, texts, _mix(seeds), k):
                plain = [] if with_ids else [x.replace(SPACE, " ") for x in texts[start : start + found.texts]]
                for turn, (here, total, value, score, ids, ends) in enumerate(segmentations(p, found), 1):
                    cols = [b.column(0).take(pa.array(here + start)), pa.array(np.full(len(here), turn, dtype=np.int32)), pa.array(np.diff(ends))]
                    cols += [pa.array(x) for x in (total, value, score)]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
                    else:
                        code, cut = ids.astype("<u4"), ends.tolist()
                        cols.append(pa.array([zlib.crc32(code[i:j]) for i, j in zip(cut, cut[1:])], pa.int64()))
                        cols.append(pa.array(p.decoded(ids, ends, [plain[i] for i in here.tolist()])))
                    yield pa.RecordBatch.from_arrays(cols, names)
                del found
        trim_memory()

    names = [key, "sample", "n_pieces", "log_prob", "perturbed", "inclusion", *(["ids"] if with_ids else ["ids_crc32", "decoded"])]
    kind = dict(docs.dtypes)[key]
    more = "ids array<int>" if with_ids else "ids_crc32 long, decoded boolean"
    src = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(key).alias("_seed"))
    return src.mapInArrow(run, f"`{key}` {kind}, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, {more}")


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with the text of its piece ids in ``out``; null ids give null."""
    path = path or model_path()
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def text(column):
        p = pieces(path)
        return column.map(lambda x: None if x is None else p.decode(x.tolist()))

    return df.withColumn(out, text(F.col(ids)))


def segments_query(docs: DataFrame) -> DataFrame:
    return sample(docs, with_ids=False)
