"""The pipeline's stages, each against a plain version of itself on its own input, over whole small tables."""

import hashlib
from collections import Counter

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")

import public_tokenizers  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
from facadelake.llm import byte_bpe  # noqa: E402
from tests.llm.test_ngram_join import plain_components  # noqa: E402

ROOT = "/root/testdata/sf0.001"


def lines_left(rows):
    """Line dedup by a dictionary of windows; documents of which nothing is left go."""
    seen, out = set(), []
    for doc, text in sorted(rows):
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        gone = set()
        for j in range(len(at) - 2):
            window = tuple(lines[i].strip(" \t\x0b\x0c\r") for i in at[j : j + 3])
            if window in seen:
                gone |= set(range(at[j], at[j + 2] + 1))
            seen.add(window)
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or left.strip(" \t\n\x0b\x0c\r"):
            out.append((doc, left))
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns, inputs, outputs = docs.columns, {}, {}
    for name, stage in cp.STAGES:
        inputs[name] = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, ROOT).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outputs[name] = docs.collect()
        assert name == "tokens" or docs.columns == columns
    assert len(cp.STAGES) == 5
    # All test documents are prose of a learned language, which stay.
    assert len(outputs["language"]) == len(inputs["language"])
    assert sorted((r.doc_id, r.text) for r in outputs["repeated_lines"]) == lines_left(inputs["repeated_lines"])
    assert all(r.n_chars == len(r.text) for r in outputs["repeated_lines"])
    plain = plain_components(inputs["near_duplicates"], 5, 80)
    assert sorted(r.doc_id for r in outputs["near_duplicates"]) == [d for d, _, c in plain if c == d]
    assert len(outputs["near_duplicates"]) < len(inputs["near_duplicates"])
    drawn = Counter(r.doc_id for r in outputs["mixture"])
    assert set(drawn) <= {d for d, _ in inputs["mixture"]} and max(drawn.values()) <= 3
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    clean = [d for d, _ in inputs["mixture"] if labels.get(d) == (1, 0)]
    assert sum(d in drawn for d in clean) >= 0.95 * len(clean)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    want = []
    for d, t in inputs["tokens"]:
        ids = np.array(library.encode_ordinary(t), "<u4")
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, outputs["tokens"])) == sorted(want)


def test_run(spark):
    out = cp.run(spark, ROOT)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
