"""Counts against a plain dynamic programme word by word and, for short words, all segmentations; edge cases."""

import itertools
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from facadelake.llm import token_counts as tc  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(word, scores, byte):
    best = [(0, 0)]
    for i in range(1, len(word) + 1):
        found = [(best[j][0] + scores[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in scores]
        if word[i - 1] not in scores:
            size = len(word[i - 1].encode())
            found.append((best[i - 1][0] + size * byte, best[i - 1][1] - size))
        best.append(max(found))
    return -best[-1][1]


def test_small_vocabulary():
    scores = {"a": -5, "b": -6, "ab": -8, "aba": -12, "bab": -12, "abab": -17}
    trie = tc.Trie(scores)
    words = ["".join(p) for n in range(1, 8) for p in itertools.product("abc", repeat=n)]
    random.Random(1).shuffle(words)
    assert trie.counts(words).tolist() == [plain(w, scores, trie.byte) for w in words]
    assert trie.byte < min(scores.values())


def test_vocabulary(spark):
    rng = random.Random(2)
    scores = tc.vocabulary(PATH)
    pool = [p for p in scores if tc.MARK not in p and len(p) > 1]
    words = list({"".join(rng.choice(pool) for _ in range(rng.randrange(1, 5))) for _ in range(3000)}) + ["\U0001f600é漢", "x" * 5000, "Zürich!?", "\x1c", "߷"]
    trie = tc.Trie(scores)
    marked = [tc.MARK + w for w in words]
    assert trie.counts(marked).tolist() == [plain(w, scores, trie.byte) for w in marked]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(200)] + [(300, None), (301, ""), (302, " \n"), (5, "twice"), (5, "twice"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS n_tokens")
    got = sorted(map(str, (tuple(r) for r in tc.token_counts(docs, PATH).collect())))
    want = [(d, len(tc.WORD.findall(t or "")), sum(plain(tc.MARK + w, scores, trie.byte) for w in tc.WORD.findall(t or ""))) for d, t in rows]
    assert got == sorted(map(str, want))
    assert tc.token_counts(docs.limit(0), PATH).count() == 0
