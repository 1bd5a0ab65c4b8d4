"""Every stage of the pipeline takes effect, against plain versions of what it should do."""

import random
import re

import numpy as np
import pytest

from .corpus import prose
from .test_ngram_join import brute

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    items = [(i, prose(r, 30)) for i in range(5)]
    rows, labels = [], []
    for i in range(120):
        t = prose(r, r.choice([40, 120]))
        if i % 10 == 9:
            t = " ".join(w + "%%%&&&" for w in t.split())
        labels.append((i, int(i % 10 != 9), 0))
        rows.append((i, t))
    for i in range(120, 135):  # near copies, leaks and personal data
        rows.append((i, rows[i - 120][1] + (" end" if i % 2 else "")))
    rows += [(140 + i, prose(r, 40) + " " + t + " " + prose(r, 40)) for i, t in items]
    rows += [(150, prose(r, 400) + " st an.er@st.wh.ing the +1 (743) 555-3824 er"), (160, None), (161, "")]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(d, t, ["en", None][d % 2], "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return path, dict(rows), dict(items)


def test_stages(spark, folder):
    import corpus_pipeline as cp
    from filigree.llm.packing import WordIds

    path, texts, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
    step = [docs]
    for _, stage in cp.STAGES:
        step.append(stage(spark, step[-1], path))
        if len(step) <= len(cp.STAGES):
            assert step[-1].columns == docs.columns
    good, single, clean, private = ({r.doc_id: r.text for r in s.collect()} for s in step[1:5])

    assert set(good) == {d for d in texts if not (d < 135 and d % 10 == 9) and texts[d]}
    assert set(single) == {d for d, _, c in brute(list(good.items())) if d == c}
    assert set(clean) == {d for d, t in single.items() if not any(x in t for x in items.values())} and not set(range(140, 145)) & set(clean)
    assert set(private) == set(clean) and "[EMAIL]" in private[150] and "[PHONE]" in private[150]
    assert not any(re.search(r"[A-Za-z0-9]@[a-z]+\.", t) for t in private.values())
    pieces = step[5].collect()
    words = WordIds(cp.tokenizer_path())
    want = {d: len(np.frombuffer(words.ids(t), "<u4")) + 1 for d, t in private.items()}
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want
    fill = {}
    for p in pieces:
        fill[p.sequence_id] = fill.get(p.sequence_id, 0) + p.length
    assert max(fill.values()) <= 2048
    assert cp.run(spark, path).count() == len(pieces)
