import hashlib
import random

import corpus_pipeline
import numpy as np
from helpers import prose
from lodestone.llm import boilerplate, byte_pairs, mixing
from test_near_duplicates import brute as components
from test_toxicity import corpus
from tokenizers import Tokenizer


def test_stages_follow_brute_force(spark, tmp_path):
    docs, labels = corpus(spark, 450)
    r = random.Random(1)
    rows = [tuple(x) for x in docs.collect()]
    rows += [(1000 + i, rows[i * 3 + 1][1], "en", "t", 0) for i in range(20)]  # copies of clean documents
    rows += [(2000 + i, f"shared menu line\n{prose(5000 + i, r.randrange(30, 60))}", "en", "u", 0) for i in range(60)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s", 0)]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(now)
        if name != "byte_pairs":
            assert now.columns == docs.columns
    clean, lines, single, mix, coded = kept
    left = {x["doc_id"] for x in clean.collect()}
    toxic = {i for i in range(450) if i % 3 == 0}
    assert len(toxic & left) <= 0.05 * len(toxic) and len({x[0] for x in rows} - toxic - left) <= 0.03 * len(rows)
    texts = {x["doc_id"]: x["text"] for x in lines.collect()}
    assert set(texts) == left and texts[3000] is None
    assert all("shared menu" not in texts[i] for i in range(2000, 2060))
    assert all(x["n_chars"] == len(x["text"] or "") for x in lines.collect())
    assert sorted(x["doc_id"] for x in single.collect()) == sorted(i for i, (_, c) in components(texts, 80).items() if i == c)
    plan = {x["doc_id"]: x["copies"] for x in mixing.mix(single).collect()}
    assert sorted(x["doc_id"] for x in mix.collect()) == sorted(i for i, n in plan.items() for _ in range(n))
    public = Tokenizer.from_file(byte_pairs.vocabulary_path())
    for x in coded.collect():
        text = texts[x["doc_id"]] or ""
        ids = public.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(x["ids"], "<u4").tolist() == ids and x["n_tokens"] == len(ids)
        assert x["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((x["doc_id"], x["ids_sha256"]) for x in df.collect())
    assert key(whole) == key(coded)
    assert boilerplate.RATIO < 0.1
