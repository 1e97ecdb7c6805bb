"""Token counts of a byte-pair vocabulary, without tokens: a heap of adjacent pairs over a linked list of symbols.

The piece's symbols are a doubly linked list. The heap holds the rank of every adjacent pair that can be merged; the
lowest rank (of equal ones the leftmost pair) is popped, the pair becomes one symbol, and its two new neighbour pairs are
pushed. A popped pair that is no longer there is skipped. The count is the number of first symbols less the merges, so
no identifier is looked up. A piece of n symbols costs n log n.

The vocabulary file names its own text normalisation and cutting into pieces; both are read from it.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Words and pieces whose counts a worker remembers: twice so many of each, of at most so many bytes.
REMEMBERED = 250_000
LONGEST = 64
# More symbols than a vocabulary has; bits of a place in a piece.
SPAN, PLACE = 1 << 20, 40
LIMIT = 2_048


def default_vocabulary() -> str:
    """The public 49k vocabulary with word ends; any byte-pair .json file can be named instead."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """Symbol pairs of a vocabulary, numbered for the time of counting: first symbols, then what pairs become."""

    def __init__(self, model: dict) -> None:
        if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("unk_token"):
            raise ValueError("only plain byte-pair merging is supported")
        number = {s: k for k, s in enumerate(model["vocab"])}
        if len(number) > SPAN:
            raise ValueError("the vocabulary is too large")
        self.end = model.get("end_of_word_suffix") or ""
        self.first = number
        # numbers of both sides -> rank and number of the merged symbol
        self.merged = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merged[number[a] * SPAN + number[b]] = rank * SPAN + number[a + b]

    def symbols(self, piece: str) -> list[int]:
        """First symbols: one per character, the last with the mark of a word's end. Unknown ones are left out."""
        found = [*map(self.first.get, piece[:-1]), self.first.get(piece[-1:] + self.end)] if piece else []
        return found if None not in found else [s for s in found if s is not None]

    def count(self, piece: str) -> int:
        """Symbols left when no pair can be merged any more."""
        symbols, merged = self.symbols(piece), self.merged.get
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        # ranks in the upper bits, places in the lower ones
        heap = [v // SPAN << PLACE | at for at, (a, b) in enumerate(zip(symbols, symbols[1:])) if (v := merged(a * SPAN + b)) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            lowest = heapq.heappop(heap)
            at = lowest & (1 << PLACE) - 1
            next_ = right[at]
            v = merged(symbols[at] * SPAN + symbols[next_]) if next_ >= 0 else None
            if v is None or v // SPAN != lowest >> PLACE:
                continue  # the pair is no longer there
            merges += 1
            symbols[at] = own = v % SPAN
            right[at] = after = right[next_]
            right[next_] = -1
            if after >= 0:
                left[after] = at
                if (v := merged(own * SPAN + symbols[after])) is not None:
                    heapq.heappush(heap, v // SPAN << PLACE | at)
            if (before := left[at]) >= 0 and (v := merged(symbols[before] * SPAN + own)) is not None:
                heapq.heappush(heap, v // SPAN << PLACE | before)
        return n - merges


class _Remembered(dict):
    """Results of a function of a short key. When full, what was not asked for since the last time is forgotten."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of, self.before = of, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.of(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class Counter:
    """Token counts of texts under one vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only added tokens that stand as they are in the text are supported")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        whole = Tokenizer.from_file(path)
        self.normalise = whole.normalizer.normalize_str if whole.normalizer else str
        self.cut = whole.pre_tokenizer.pre_tokenize_str
        self.merges = Merges(spec["model"])
        self.piece = _Remembered(self.merges.count)
        self.word = _Remembered(self._count_word)
        # white space that is dropped can't join pieces: such texts are counted word by word
        cut = [p for p, _ in self.cut(self.normalise("a b \t c"))]
        self.by_word = cut == ["a", "b", "c"]
        self.plain = self._plain_cut(spec)

    def _plain_cut(self, spec: dict):
        """A function that cuts words of printable ASCII as the file says, or None if it says other things than these."""
        steps, (first, *rest) = spec["normalizer"].get("normalizers", [{}]), spec["pre_tokenizer"].get("pretokenizers", [{}])
        own = [{k: v for k, v in s.items() if k != "trim_offsets"} for s in rest]
        pattern = first.get("pattern", {}).get("Regex")
        if (
            [s.get("type") for s in steps] != ["NFC", "Replace", "Lowercase"] or steps[1] != {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
            or pattern is None or (first["behavior"], first["invert"]) != ("Removed", True) or own != [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
        ):
            return None
        find = regex.compile(pattern).findall
        return lambda word: find(word.lower())

    def _count_word(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        if self.plain and text.isascii() and text.isprintable() and not (self.added and self.added.search(text)):
            return sum(map(self.piece.__getitem__, self.plain(text)))
        return self._count(text)

    def _count(self, text: str) -> int:
        parts = self.added.split(text) if self.added else [text]
        tokens = len(parts) // 2  # every other part is an added token
        for part in parts[::2]:
            if part:
                tokens += sum(self.piece[p] for p, _ in self.cut(self.normalise(part)))
        return tokens

    def count(self, text: bytes | None) -> int:
        """Tokens of a text in UTF-8."""
        if not text:
            return 0
        return sum(map(self.word.__getitem__, text.split())) if self.by_word else self._count(text.decode("utf-8", "replace"))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text.

    Null texts count as empty: no bytes, no tokens. Added tokens of the vocabulary count as one where their string
    stands in a text. Repeated rows and null ids are all returned; other columns are ignored. An empty table gives an
    empty result. The vocabulary file must be readable on all executors.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            tokens, sizes = [], []
            for text in batch.column("text").cast(pa.binary()):
                text = text.as_py()
                tokens.append(count(text))
                sizes.append(len(text or b""))
            n_tokens = pa.array(tokens, pa.int64())
            over = pa.array([n > limit for n in tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), n_tokens, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    return source.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean")
