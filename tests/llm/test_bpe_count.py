"""Token counts against the tokenizer library, and the heap against plain repeated merging."""

import random

from dosewise.llm import bpe_count
from dosewise.llm.common import table
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"


def test_given_documents(spark):
    library = Tokenizer.from_file(bpe_count.default_vocabulary())
    rows = table(spark, SF, "documents").toPandas()
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in zip(rows.doc_id, rows.text)}
    got = bpe_count.token_counts(table(spark, SF, "documents")).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)


def test_odd_texts_as_the_library():
    library = Tokenizer.from_file(bpe_count.default_vocabulary())
    own = bpe_count.counter(bpe_count.default_vocabulary())
    rng = random.Random(3)
    alphabet = list("abcdeABC'stvrldm019.,!<|>_-") + [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "\x00", "​"] + list("éÉßİıΣσςΟΔΥΣǅ漢字かな한글ⅷ²½٣😀👩‍👧̧́éﬁ") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "it's", "WE'LL", "the", "ing"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    texts += ["", " ", "<|endoftext|>" * 3, "a<|startoftext|>b", "ΟΔΥΣΣΕΥΣ", "x" * 30_000, "ab" * 20_000, "漢" * 5_000, "😀" * 3_000, "é" * 2_000, " ́a"]
    for text in texts:
        assert own.count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_heap_as_plain_merging():
    rng = random.Random(4)
    for _ in range(300):
        letters = "abc"
        known = set(letters) | {c + "</w>" for c in letters}
        merges = []
        for _ in range(12):
            a, b = rng.choice([s for s in sorted(known) if not s.endswith("</w>")]), rng.choice(sorted(known))
            if [a, b] not in merges:
                merges.append([a, b])
                known.add(a + b)
        tool = bpe_count.Merges({"merges": merges, "vocab": dict.fromkeys(sorted(known)), "end_of_word_suffix": "</w>"})
        rank = {tuple(m): k for k, m in enumerate(merges)}
        piece = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 30)))
        symbols = list(piece[:-1]) + [piece[-1] + "</w>"] if piece else []
        while pairs := [(rank[p], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in rank]:
            _, k = min(pairs)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        assert tool.count(piece) == len(symbols)


def test_full_memory_is_forgotten(monkeypatch):
    monkeypatch.setattr(bpe_count, "REMEMBERED", 3)
    tool = bpe_count.Counter(bpe_count.default_vocabulary())
    assert [tool.count(t.encode()) for t in ("a b c d e f g a g", "a b", "hello hello")] == [9, 2, 2] and len(tool.word) <= 3 >= len(tool.word.before)


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "<|endoftext|> hi"), (4, "hi"), (4, "hi")]
    got = [tuple(r) for r in bpe_count.token_counts(docs(rows), limit=1).orderBy("doc_id").collect()]
    assert got == [(None, 16, 2, True), (1, 0, 0, False), (2, 0, 0, False), (3, 2, 0, False), (4, 2, 1, False), (4, 2, 1, False)]
    assert bpe_count.token_counts(docs([])).count() == 0
