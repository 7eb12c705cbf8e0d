import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from textmill.llm import mixing, packing, toxicity

from ..conftest import DATA
from .test_jaccard import kept_by_hand

SF = str(DATA / "sf0.001")


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        after = {r.doc_id for r in rows}
        assert after <= before.keys()
        if k < 4:
            assert out.columns == columns and all(before[r.doc_id] == r.text for r in rows)
        seen.append(len(rows))
        if name == "toxicity":
            scores = toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
            assert after == {r.doc_id for r in scores if not r.predicted}
        if name == "exact_dedup":
            norm = {d: re.sub(r"[\x20\x09-\x0D]", "", t) for d, t in before.items()}
            best = {}
            for d, n in norm.items():
                best[n] = min(best.get(n, d), d, key=lambda x: (-len(before[x]), x))
            assert after == set(best.values())
        if name == "near_dedup":
            assert after == kept_by_hand(list(before.items()))
        if name == "mixing":
            want = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            assert Counter(r.doc_id for r in rows) == Counter({d: c for d, c in want.items() if c})
        if name == "packing":
            encode = packing.Encoder(*packing.public_encoder_paths())
            copies = Counter(r.doc_id for r in docs.collect())
            fill = Counter()
            tokens = Counter()
            for r in rows:
                fill[r.sequence_id] += r.length
                tokens[r.doc_id] += r.length
                whole = np.append(encode(before[r.doc_id]), np.uint32(1)).astype("<u4")
                assert zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            assert tokens == {d: n * (len(encode(before[d])) + 1) for d, n in copies.items()}
            assert all(v & (v - 1) == 0 and v <= 2048 for v in fill.values())
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
