"""The pipeline against a brute-force version on a small corpus."""

import random

import corpus_pipeline
from ruleweave.llm import exact_dedup

from .test_dedup import near_brute
from .test_text_operators import toxic_rows


def test_pipeline(spark, tmp_path):
    rnd = random.Random(3)
    rows = toxic_rows()
    texts = [(i, t) for i, t, _ in rows]
    plain = [t for _, t, y in rows if not y]
    texts += [(1000 + i, plain[i]) for i in range(20)] + [(1100, plain[0] + " ")]
    for i in range(20):
        words = plain[i + 30].split()
        words[rnd.choice([0, -1])] = "other"
        texts.append((2000 + i, " ".join(words)))
    texts += [(3000, None), (3001, ""), (1000, plain[0])]
    docs = spark.createDataFrame(
        [(i, t, "en", "src0", len(t or "")) for i, t in texts],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )

    # Each stage is judged on what the stage before it kept.
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), [sorted(texts, key=str)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert set(now.columns) == set(docs.columns)
        kept.append(sorted(((r.doc_id, r.text) for r in now.select("doc_id", "text").collect()), key=str))
    start, clean, single, apart = kept

    bad = ("badword", "wretched", "zorg")
    gone = [x for x in start if x not in clean]
    assert all(any(b in t for b in bad) for _, t in gone) and len(gone) >= 95

    best = {}
    for i, t in clean:
        key = "".join(c for c in (t or "") if c not in exact_dedup.BLANKS)
        best[key] = min(best.get(key, (-len(t or ""), i, t)), (-len(t or ""), i, t), key=lambda x: x[:2])
    assert sorted(((i, t) for _, i, t in best.values()), key=str) == single

    names = {i for i, _, _, keep in near_brute(single, 5, 80) if keep}
    assert sorted((x for x in single if x[0] in names), key=str) == apart

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in apart}
    room = {}
    for r in packed:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in room.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= corpus_pipeline.CAPACITY
