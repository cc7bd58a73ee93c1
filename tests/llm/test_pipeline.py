"""The corpus pipeline against plain versions of its stages, and the entry without the corpus operators."""

from __future__ import annotations

import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
from test_jaccard import brute as brute_near
from test_passages_and_lines import LENGTH, brute_lines
from test_text_operators import PATH, plain_measures

REPO = Path(__file__).resolve().parents[2]


def documents():
    rng = random.Random(11)
    words = [f"wörd{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    line = "a line that many documents have in common"
    out = {}
    for k in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        parts = [" ".join(own)]
        if rng.random() < 0.4:
            parts.append(line if rng.random() < 0.5 else f"  {line.upper()} ")
        if rng.random() < 0.3:
            parts[0] += " " + passage + " " + " ".join(rng.choice(words) for _ in range(20))
        out[k] = "\n".join(parts)
    for k in range(60, 75):
        base = out[rng.randrange(60)].split(" ")
        base[rng.randrange(len(base))] = "changed"
        out[k] = " ".join(base)
    return out | {80: None, 81: "", 82: "x " * 100, 83: out[3], 84: out[3], 85: "word " * 3000 + " ".join(words)}


def brute_passages(docs):
    seen, out = set(), {}
    for k in sorted(docs):
        b = docs[k].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - LENGTH + 1):
            w = b[i : i + LENGTH]
            if w in seen:
                gone[i : i + LENGTH] = b"\1" * LENGTH
            seen.add(w)
        text, at = [], 0
        for c in docs[k]:
            size = len(c.encode())
            if not any(gone[at : at + size]):
                text.append(c)
            at += size
        out[k] = "".join(text)
    return out


def test_pipeline_matches_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = documents()
    rows = [(k, t, "en", f"h{k % 4}", None, "extra") for k, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Other string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for k, t in docs.items():
        n, _, _, _, again = plain_measures(t)
        if n >= 20 and 100 * again <= 30 * n:
            want[k] = t
    want = {k: v[2] for k, v in brute_lines(want).items()}
    classes = brute_near(want)
    want = brute_passages({k: t for k, t in want.items() if classes[k][0] == k})
    library = Tokenizer.from_file(PATH)
    ids = {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in want.items()}
    found: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    import zlib

    assert set(found) == set(ids)
    for k, pieces in found.items():
        at = 0
        for start, length, crc, total in sorted(pieces):
            assert start == at and total == len(ids[k])
            assert crc == zlib.crc32(np.array(ids[k][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids[k])


def test_stages_return_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").collect() == []


def test_entry_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "annalist"):
        source = REPO / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "annalist/llm")
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'join_two_hop' in names and 'pipeline' not in names and set(e.oracle_sql()) <= names"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
