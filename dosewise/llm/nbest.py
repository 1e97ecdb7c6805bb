"""N-best segmentation over a SentencePiece vocabulary.

No piece crosses from a character into a following space mark, so the piece lattice of a text falls into the lattices of
its words. For all distinct words of a batch at once, forward and backward Viterbi give the best segmentation and how
much the next one loses. The N best segmentations of the text differ from the best one in at most N - 1 of the words
that lose least; only these are searched, backward by A-star with the forward scores as exact heuristic.

Segmentations are ordered by score (the sum of piece scores), equal ones by their ids read from
the end. A character without a piece is written as its UTF-8 byte pieces, at 10 below the lowest score.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cmp_to_key, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
# Words handled at once and words remembered between texts, both bound memory. Most words occur once; those that texts use
# again stay.
WORDS_AT_ONCE = 8_192
REMEMBERED = 200_000
# Longer words are searched one by one.
LONGEST = 48
# A-star costs the square of a word's length; words beyond this keep n-best lists at every position instead.
LINEAR = 2_000
# Texts of one step: so many of so many characters, or one longer text.
TEXTS_AT_ONCE, CHARACTERS_AT_ONCE = 512, 400_000
ODD = np.uint64(0x9E3779B97F4A7C15)

# One edit of the best segmentation: at piece `at`, `drop` pieces give way to `ids`.
OTHERS = pa.list_(pa.struct({
    "score": pa.float64(), "edits": pa.list_(pa.struct({"at": pa.int32(), "drop": pa.int32(), "ids": pa.list_(pa.int32())})),
}))
EDITS = "array<struct<score:double,edits:array<struct<at:int,drop:int,ids:array<int>>>>>"


def default_model() -> str:
    """The public 32k piece vocabulary; any .model file can be named instead."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces and scores of a model file, and a hash index over their code points."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        usable = [i for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        self.score = np.array([self.model.get_score(i) for i in range(n)], dtype=np.float64)
        self.piece = {self.model.id_to_piece(i): i for i in usable}
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = min((self.score[i] for i in usable if self.score[i] > -1e8), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.piece))
        crossing = [p for p in self.piece if SPACE in p.strip(SPACE)]
        if crossing:
            raise ValueError("pieces with a space mark inside are not supported")
        alone = "\n" if not any("\n" in p for p in self.piece) else ""
        self.split = re.compile(f"{alone}|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        # pieces by a 64-bit hash of their code points, in two tables addressed by its upper bits
        self.ids = np.array(list(self.piece.values()), dtype=np.int64)
        lengths = np.array([len(p) for p in self.piece])
        points = np.zeros((len(self.ids), self.longest), dtype=np.uint64)
        for row, p in enumerate(self.piece):
            points[row, : len(p)] = [ord(c) for c in p]
        self.hashes = np.zeros(len(self.ids), dtype=np.uint64)
        for k in range(self.longest):
            self.hashes = np.where(k < lengths, self.hashes * ODD + points[:, k], self.hashes)
        if len(np.unique(self.hashes)) != len(self.hashes):
            raise ValueError("two pieces have one hash")
        left, self.tables = np.arange(len(self.ids)), []
        while len(left):  # what finds its place taken goes to the next table
            table = np.full(1 << 20, -1, dtype=np.int32)
            where = self._address(self.hashes[left], len(self.tables))
            table[where] = left
            self.tables.append(table)
            left = left[table[where] != left]
        self.piece_scores = self.score[self.ids]
        self.byte_ids = np.array(self.bytes)

    @staticmethod
    def _address(hashes: np.ndarray, turn: int) -> np.ndarray:
        return ((hashes + np.uint64(turn)) * ODD) >> np.uint64(44)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions that are pieces, rows of these pieces). A text of 64-bit equal hash would show when decoded."""
        first = self.tables[0][self._address(hashes, 0)]
        at = np.flatnonzero(first >= 0)
        rows = first[at]
        same = self.hashes[rows] == hashes[at]
        found, pieces, at = [at[same]], [rows[same]], at[~same]
        for turn, table in enumerate(self.tables[1:], start=1):
            rows = table[self._address(hashes[at], turn)]
            same = (rows >= 0) & (self.hashes[rows] == hashes[at])
            found.append(at[same])
            pieces.append(rows[same])
            at = at[~same]
        return np.concatenate(found), np.concatenate(pieces)

    def spelled(self, char: str) -> list[int]:
        """Ids of a character that has no piece."""
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]

    def edges(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end, the (start, score, ids) of the pieces that end there."""
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(word) + 1)]
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                at = self.piece.get(word[i:j])
                if at is not None:
                    into[j].append((i, float(self.score[at]), (at,)))
                elif j == i + 1:
                    into[j].append((i, self.unknown, tuple(self.spelled(word[i]))))
        return into


def nbest(word: str, n: int, vocabulary: Vocabulary) -> list[tuple[float, tuple[int, ...]]]:
    """The n best (score, ids) of one word by A-star from its end; forward Viterbi scores are exact heuristics."""
    into = vocabulary.edges(word)
    if len(word) > LINEAR:
        return _nbest_lists(into, n)
    forward = [0.0] + [-np.inf] * len(word)
    for j in range(1, len(word) + 1):
        forward[j] = max(forward[i] + s for i, s, _ in into[j])
    # the ids from the end break ties, so among equals only the path that is next in order is followed
    heap: list[tuple] = [(-forward[-1], (), len(word), 0.0)]
    found: list[tuple[float, tuple[int, ...]]] = []
    while heap and len(found) < n:
        bound, reverse, end, behind = heapq.heappop(heap)
        if end == 0:
            found.append((-bound, reverse[::-1]))
            continue
        for i, s, own in into[end]:
            heapq.heappush(heap, (-(forward[i] + s + behind), reverse + own[::-1], i, s + behind))
    return found


def _nbest_lists(into: list, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The same by forward Viterbi with the n best at every position; linear in the word's length."""
    lists: list[list[tuple]] = [[(0.0, (), 0, 0)]]
    for j in range(1, len(into)):
        options = [(-(was[0] + s), own[::-1], rank, i) for i, s, own in into[j] for rank, was in enumerate(lists[i])]
        lists.append([(-o[0], o[1], o[2], o[3]) for o in heapq.nsmallest(n, options)])
    found = []
    for score, own, rank, i in lists[-1]:
        reverse, last = list(own), len(into) - 1
        while i > 0 or last > 0:
            last = i
            if last == 0:
                break
            _, own, rank, i = lists[last][rank]
            reverse += own
        found.append((score, tuple(reverse[::-1])))
    return found


def _tables(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """For words of at most LONGEST characters: (offsets, piece ids of the best, its score, what the next one loses).

    Forward and backward Viterbi over all words at once, position by position. The next best segmentation is the best
    one through any piece outside the best; it loses 0 where two tie.
    """
    points = np.array(words, dtype=f"<U{LONGEST}").view(np.uint32).reshape(len(words), LONGEST)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max())
    order = np.argsort(-lengths, kind="stable")  # long words first: position p concerns a leading slice
    points, sizes = np.ascontiguousarray(points[order, :width].T.astype(np.uint64)), lengths[order]
    alive = [int(np.searchsorted(-sizes, -p, side="right")) for p in range(width + 1)]  # words of length >= p
    hits: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(width + 1)]
    for i in range(width):
        rolling = np.zeros(alive[i + 1], dtype=np.uint64)
        for k in range(1, min(vocabulary.longest, width - i) + 1):
            count = alive[i + k]
            if not count:
                break
            rolling = rolling[:count] * ODD + points[i + k - 1, :count]
            rows, at = vocabulary.lookup(rolling)
            if len(rows):
                hits[i].append((k, rows, vocabulary.piece_scores[at], vocabulary.ids[at]))
            if k == 1 and len(rows) < count:
                single = np.ones(count, dtype=bool)
                single[rows] = False
                rows = np.flatnonzero(single)
                hits[i].append((1, rows, np.full(len(rows), vocabulary.unknown), -1 - rows))
    n = len(words)
    forward = np.full((width + 1, n), -np.inf)
    forward[0] = 0.0
    came = np.zeros((width + 1, n), dtype=np.int32)  # length of the piece into a position
    with_id = np.zeros((width + 1, n), dtype=np.int32)
    last_id = np.zeros((width + 1, n), dtype=np.int32)  # its last id, by which equal scores are told apart
    for i in range(width):
        for k, rows, scores, ids in hits[i]:
            last = ids
            if ids[0] < 0:
                char = points[i, rows].astype(np.int64)
                last = vocabulary.byte_ids[np.where(char < 128, char, 128 | (char & 63))]
            new, old = forward[i, rows] + scores, forward[i + k, rows]
            better = (new > old) | ((new == old) & (last < last_id[i + k, rows]))
            rows = rows[better]
            forward[i + k, rows], came[i + k, rows], with_id[i + k, rows], last_id[i + k, rows] = new[better], k, ids[better], last[better]
    backward = np.full((width + 1, n), -np.inf)
    backward[sizes, np.arange(n)] = 0.0
    for i in range(width - 1, -1, -1):
        for k, rows, scores, _ in hits[i]:
            backward[i, rows] = np.maximum(backward[i, rows], scores + backward[i + k, rows])
    best = forward[sizes, np.arange(n)]
    on_best = np.zeros((width + 1, n), dtype=bool)  # positions the best passes through
    where, rows, steps = sizes.copy(), np.arange(n), []
    while len(rows):
        on_best[where[rows], rows] = True
        rows = rows[where[rows] > 0]
        steps.append((rows, where[rows], with_id[where[rows], rows]))
        where[rows] -= came[where[rows], rows]
    second = np.full(n, -np.inf)
    for i in range(width):
        for k, rows, scores, _ in hits[i]:
            through = forward[i, rows] + scores + backward[i + k, rows]
            own = on_best[i, rows] & on_best[i + k, rows] & (came[i + k, rows] == k)
            second[rows] = np.maximum(second[rows], np.where(own, -np.inf, through))
    owner = np.concatenate([s[0] for s in steps]) if steps else np.zeros(0, np.int64)
    end = np.concatenate([s[1] for s in steps]) if steps else owner
    ids = np.concatenate([s[2] for s in steps]) if steps else owner
    sequence = np.lexsort((end, order[owner]))
    owner, end, ids = order[owner[sequence]], end[sequence], ids[sequence]
    if (ids < 0).any():  # characters without a piece become several ids
        pieces = [[int(i)] if i >= 0 else vocabulary.spelled(words[w][e - 1]) for w, e, i in zip(owner, end, ids)]
        owner = np.repeat(owner, [len(p) for p in pieces])
        ids = np.array([i for p in pieces for i in p], dtype=np.int64)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=n), out=offsets[1:])
    back = np.argsort(order, kind="stable")
    return offsets, ids.astype(np.int32), best[back], (best - second)[back]


class Segmenter:
    """N-best segmentations of texts; remembers words between texts, up to a bound."""

    def __init__(self, path: str, n: int) -> None:
        if n < 1:
            raise ValueError("n must be at least 1")
        self.vocabulary, self.n = Vocabulary(path), n
        self.known: dict[str, int] = {}
        self.alternatives: dict[str, list] = {}
        self.start = np.zeros(0, np.int64)
        self.count, self.best, self.loss = self.start, np.zeros(0), np.zeros(0)
        self.pool = np.zeros(0, np.int32)
        self.used = np.zeros(0, np.int64)  # texts that had the word, halved at each trim

    def _ids(self, at: np.ndarray) -> np.ndarray:
        """The best ids of the words at these places, one after the other."""
        counts = self.count[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.start[at] - (ends - counts), counts) + np.arange(total)]

    def _trim(self) -> None:
        """Forgets words of one text, and the less used half of the bound."""
        kept = np.flatnonzero(self.used > 1)
        if len(kept) > REMEMBERED // 2:
            kept = np.sort(kept[np.argsort(-self.used[kept], kind="stable")[: REMEMBERED // 2]])
        names = list(self.known)
        self.known = {names[at]: k for k, at in enumerate(kept.tolist())}
        self.pool, self.count, self.best, self.loss, self.used = (
            self._ids(kept), self.count[kept], self.best[kept], self.loss[kept], self.used[kept] // 2)
        self.start = np.cumsum(self.count) - self.count

    def _learn(self, words: list[str]) -> None:
        slow = [w for w in words if len(w) > LONGEST or "\0" in w]
        short = [w for w in words if len(w) <= LONGEST and "\0" not in w]
        parts = []
        for at in range(0, len(short), WORDS_AT_ONCE):
            some = short[at : at + WORDS_AT_ONCE]
            offsets, ids, best, loss = _tables(some, self.vocabulary)
            parts.append((some, ids, np.diff(offsets), best, loss))
        for w in slow:
            found = nbest(w, 2, self.vocabulary)
            gap = found[0][0] - found[1][0] if len(found) > 1 else np.inf
            parts.append(([w], np.array(found[0][1], np.int32), np.array([len(found[0][1])]), np.array([found[0][0]]), np.array([gap])))
        for names, *_ in parts:
            for w in names:
                self.known[w] = len(self.known)
        self.pool, self.count, self.best, self.loss = (
            np.concatenate([old, *[p[k] for p in parts]]) for k, old in enumerate((self.pool, self.count, self.best, self.loss), start=1))
        self.start = np.cumsum(self.count) - self.count
        self.used = np.concatenate([self.used, np.zeros(len(self.known) - len(self.used), np.int64)])

    def _others(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        if word not in self.alternatives:
            self.alternatives[word] = nbest(word, self.n, self.vocabulary)
        return self.alternatives[word]

    def segment(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, float, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]]:
        """For each text: (best ids, score, other segmentations as (score, edits of the best))."""
        if len(self.known) > REMEMBERED:
            self._trim()
        if len(self.alternatives) > REMEMBERED:
            self.alternatives.clear()
        normal = [self.vocabulary.model.normalize(t.encode("utf-8", "replace").decode()) if t else "" for t in texts]
        split = [self.vocabulary.split(t) for t in normal]
        known = self.known
        new = list(set().union(*split).difference(known))
        if new:
            self._learn(new)
        for words in split:
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            self.used[at] += 1
            counts, best = self.count[at], float(self.best[at].sum())
            yield self._ids(at), best, self._next(words, at, np.cumsum(counts) - counts, counts, best)

    def _next(self, words: list[str], at: np.ndarray, begin: np.ndarray, counts: np.ndarray, best: float) -> list:
        n = self.n - 1
        if not n or not len(words):
            return []
        loss = self.loss[at]
        finite = np.flatnonzero(np.isfinite(loss))
        if len(finite) > n:
            cut = np.partition(loss[finite], n - 1)[n - 1]
            near = finite[loss[finite] <= cut]
            if cut == 0:  # other segmentations of equal score come after the best: the first places go before later ones
                near = near[:n]
            elif len(near) > 2 * n:  # many ties: the first and last n places of each word suffice
                places: dict[int, list[int]] = {}
                for p in near.tolist():
                    places.setdefault(int(at[p]), []).append(p)
                near = np.array(sorted({p for own in places.values() for p in own[:n] + own[-n:]}))
        else:
            near = finite
        options = {p: [(top[0] - score, ids) for score, ids in others] for p in near.tolist() for top, *others in [self._others(words[p])]}
        best_ids = {p: self._others(words[p])[0][1] for p in options}

        def order(a: tuple, b: tuple) -> int:
            """By loss, then by the ids at the last place where two segmentations differ."""
            if a[0] != b[0]:
                return -1 if a[0] < b[0] else 1
            for p in sorted(a[1].keys() | b[1].keys(), reverse=True):
                u, v = a[1].get(p, best_ids[p])[::-1], b[1].get(p, best_ids[p])[::-1]
                if u != v:
                    return -1 if u < v else 1
            return 0

        rank = cmp_to_key(order)
        # a segmentation among the next n changes only places whose single changes are among the next n
        changes = sorted(((lost, {p: ids}) for p, own in options.items() for lost, ids in own), key=lambda c: c[0])
        limit = changes[min(n, len(changes)) - 1][0] if changes else 0.0
        singles = sorted((c for c in changes if c[0] <= limit), key=rank)[:n]
        found: list[tuple[float, dict]] = [(0.0, {})]
        for p in sorted({p for _, change in singles for p in change}):
            more = [(lost + own, {**change, **single}) for lost, change in found for own, single in singles if p in single]
            found = sorted(found + more, key=rank)[: n + 1]
        return [(best - lost, [(int(begin[p]), int(counts[p]), ids) for p, ids in sorted(change.items())]) for lost, change in found[1:]]


def edited(ids: list[int], edits: list) -> list[int]:
    """The ids of another segmentation from the best ids and its edits."""
    out, done = [], 0
    for at, drop, new in edits:
        out += [*ids[done:at], *new]
        done = at + drop
    return [*out, *ids[done:]]


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive texts that are handled at once; bounds the memory of long texts."""
    sizes = np.nan_to_num(pc.utf8_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
    first, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > first and (held + size > CHARACTERS_AT_ONCE or at - first == TEXTS_AT_ONCE):
            yield first, at - first
            first, held = at, 0
        held += size
    if len(sizes):
        yield first, len(sizes) - first


@lru_cache(maxsize=2)
def segmenter(path: str, n: int) -> Segmenter:
    """One per Python worker."""
    return Segmenter(path, n)


def decode(ids: list[int], path: str) -> str:
    """Text of any segmentation; space marks come back as spaces."""
    return segmenter(path, 1).vocabulary.model.decode([int(i) for i in ids])


def encode(docs: DataFrame, path: str | None = None, n: int = 4, id_col: str = "doc_id", text_col: str = "text", hold: bool = True) -> DataFrame:
    """(doc_id, ids, score, others, decoded) of every row: the n best segmentations of the whole text.

    `ids` and `score` are the best; `others` the next n - 1 as edits of it (see `edited`), fewer where the lattice has
    fewer; `decoded` whether the ids give the text back. Only a text that holds the space mark itself or a lone
    surrogate doesn't come back, with the mark read as a space. Null texts count as empty and have no ids. Repeated
    rows are all returned; other columns are ignored. The vocabulary file must be readable on all executors. Unless `hold`,
    a worker gives up vocabulary and words when its task ends, so that later stages have the memory.
    """
    path = path or default_model()

    id_type = dict(docs.dtypes)[id_col]
    if id_type not in ("bigint", "string"):
        raise ValueError("the identifier must be a long or a string")
    source = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = segmenter(path, n)
        for batch in batches:
            for at, n_rows in steps(batch.column("text")):
                part = batch.slice(at, n_rows)
                texts = part.column("text").to_pylist()
                rows = list(tool.segment(texts))
                back = tool.vocabulary.model.decode([r[0].tolist() for r in rows])
                ends = np.cumsum([0, *[len(r[0]) for r in rows]]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[0] for r in rows]), pa.int32()))
                others = [[{"score": s, "edits": [{"at": a, "drop": d, "ids": list(i)} for a, d, i in e]} for s, e in r[2]] for r in rows]
                columns = [part.column("doc_id"), ids, pa.array([r[1] for r in rows], pa.float64()), pa.array(others, OTHERS), pa.array([b == (t or "") for b, t in zip(back, texts)])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "score", "others", "decoded"])
            pa.default_memory_pool().release_unused()  # buffers of a batch of long texts are not kept for the next
        if not hold:
            segmenter.cache_clear()

    return source.mapInArrow(run, f"doc_id {id_type}, ids array<int>, score double, others {EDITS}, decoded boolean")
