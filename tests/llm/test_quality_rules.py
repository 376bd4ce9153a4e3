"""Base figures against plain loops, boilerplate lines, edge cases."""

import random
import re
from collections import Counter

from facadelake.llm import quality_rules as q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_figures(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "x " * 500, "é é <b> $$\r\n\x0b&", "a b c d e f\n" * 3 + "#", "w " * 30_000]
    texts += [" ".join(rng.choice(["a", "b", "c\n", "\n\n", "|"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t, "s", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, line long")
    for r in q.base_figures(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(r.text), r.text
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_boilerplate(spark):
    own = lambda i: " ".join(chr(97 + i % 26) + chr(97 + i // 26) + chr(97 + j) for j in range(12))
    rows = [(i, f"Call 555{i}  NOW\n{own(i)}", "a") for i in range(40)]  # one line of many
    rows += [(100 + i, f"{own(100 + i)[:30]}\n" + "call 5 now\n" * 20 + own(i)[:3], "a") for i in range(3)]  # depleted
    rows += [(200 + i, "one text copied often, which has a dozen words and is not boilerplate at all", "b") for i in range(60)]
    rows += [(300, f"call 1 now\n{own(300)}", "c"), (301, f"call 1 now\n{own(301)}", None), (302, None, None), (300, f"call 1 now\n{own(300)}", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS host", "2 AS t", "3 AS chars")
    out = q.apply_rules(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].kept and len(got[i].removed_lines) == 1 for i in range(40))
    assert not any(got[100 + i].kept for i in range(3))
    assert all(got[200 + i].kept and got[200 + i].removed_lines is None for i in range(60))
    assert got[300].kept and got[301].kept and not got[302].kept
    cleaned = {r.doc_id: r.text for r in q.without_boilerplate(out).collect()}
    assert cleaned[3] == own(3) and cleaned[300] == f"call 1 now\n{own(300)}" and cleaned[302] is None
    assert out.count() == len(rows) and q.apply_rules(docs.limit(0)).count() == 0
