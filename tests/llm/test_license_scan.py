"""License scans against plain loops over words and windows."""

import random
import re

import pytest

from facadelake.llm.license_scan import PERCENT, PHRASES, STRIDE, TEMPLATES, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, label string, row string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, templates=TEMPLATES, percent=PERCENT, stride=STRIDE):
    out = []
    for doc_id, text in rows:
        ws = words(text)
        at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
        base, labels, score = {x for _, x in at}, {x for _, x in at}, 1.0 if at else 0.0
        for begin in range(0, len(ws) + 1, stride):
            block = set(ws[begin : begin + 2 * stride])
            for label, some in templates.items():
                for t in some:
                    t = set(words(t))
                    if 100 * len(t & block) >= percent * len(t):
                        labels.add(label)
                        score = max(score, len(t & block) / len(t))
        starts = [i for i, _ in at]
        out.append((doc_id, len(ws), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=repr)


def found(spark, rows, **kw):
    df = scan_licenses(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), **kw)
    return sorted(((*r[:-1], round(r[-1], 9)) for r in map(tuple, df.collect())), key=repr)


@pytest.fixture(scope="module")
def some():
    rng = random.Random(3)
    notices = [t for ts in TEMPLATES.values() for t in ts] + [*PHRASES, "Released under the MIT License.", "CC BY-NC 4.0", "Apache License,\nVersion 2.0"]
    vocabulary = sorted({w for t in notices for w in words(t)}) + ["é", "日本", "x1", "other", "words"]
    rows = []
    for i in range(300):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 40, 150]))]
        for _ in range(rng.randint(0, 3)):
            said = rng.choice(notices).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                said[rng.randrange(len(said))] = rng.choice(vocabulary)
            at = rng.randint(0, len(text))
            text[at:at] = said
        rows.append((i, rng.choice([" ", "\n", ", "]).join(text)))
    return rows + [(7, None), (7, None), (None, "cc by nc cc by nc"), (900, ""), (901, "under the mit"), (902, "license"), (903, "é" * 300_000 + " cc-by/nc"), (904, "a " * 50_000 + notices[0])]


def test_against_windows(spark, some):
    assert found(spark, some) == plain(some)


@pytest.mark.parametrize("percent", [50, 100])
def test_other_thresholds(spark, some, percent):
    assert found(spark, some, percent=percent) == plain(some, percent=percent)


def test_every_notice(spark):
    rows = [(i, f"Some text.\n{t}\nMore.") for i, t in enumerate(t for ts in TEMPLATES.values() for t in ts)]
    labels = [label for label, ts in TEMPLATES.items() for _ in ts]
    assert [set(r[6].split(",")) >= {x} for r, x in zip(sorted(found(spark, rows)), labels)] == [True] * len(rows)


def test_empty_and_wrong(spark):
    assert found(spark, []) == []
    with pytest.raises(ValueError):
        scan_licenses(spark.createDataFrame([], SCHEMA), templates={"x": ["..."]})
