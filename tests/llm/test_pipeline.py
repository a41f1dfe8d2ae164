"""The whole pipeline against plain Python, on one small table."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from ponding.llm import packing
from tests.llm import brute
from tests.llm.test_operators import corpus


def test_pipeline(spark, tmp_path):
    """Fewer good rows than a fit needs, so that the base rules decide the first stage; a copied, a repeated and a leaked passage."""
    rows = [(i, t) for i, t in corpus(seed=22, n=110) if i is not None]
    rows = list(dict(rows).items())
    spark.createDataFrame([(i, t, "en", None, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    good = [(i, t) for i, t in rows if not brute.statistics(t)[-1]]
    assert 40 < len(good) < 100
    component = {i: c for i, _, c in brute.jaccard_components(good)}
    apart = [(i, t) for i, t in good if component[i] == i]
    cut = [(i, t.encode()) for i, t in apart]
    first = {}
    for i, b in cut:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    left = []
    for i, b in cut:
        gone = {k + j for k in range(len(b) - 49) if first[b[k : k + 50]] < i for j in range(50)}
        left.append((i, bytes(x for k, x in enumerate(b) if k not in gone).decode(errors="ignore")))
    leaked = next(t for _, t in left[5:] if len(t.split()) > 60)
    items = [(1, " ".join(leaked.split()[12:40])), (2, None), (3, "not in any text of them")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(i, t) for (i, t), hit in zip(left, brute.contamination(left, items)) if not hit[-1]]
    assert len(good) > len(apart) > len(clean) > 10 and left != apart
    t = Tokenizer.from_file(packing.default_vocabulary())
    want = []
    for i, text in clean:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, 4096 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(ids, range(4096, len(ids), 4096)))]
    got = [tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "benchmark_passages", "packing"]
