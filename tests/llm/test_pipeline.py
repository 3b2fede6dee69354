"""The pipeline: each stage's decisions on what its predecessor kept."""

import os

import pytest

import corpus_pipeline
from sievelake.llm import packing, simhash
from tests.llm import cases

SF = "/root/testdata/sf0.001"
needed = pytest.mark.skipif(not (os.path.isdir(SF) and os.path.exists(packing.TOKENIZER)), reason="no test tables here")


@needed
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, texts = [], {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = set(kept[-1]) if kept else set(texts)
        docs = simhash.staged(stage(spark, docs, SF), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        rows = docs.collect()
        assert all(texts[r.doc_id] == r.text for r in rows)
        kept.append([r.doc_id for r in rows])
        assert set(kept[-1]) <= before and len(set(kept[-1])) == len(kept[-1])
    assert len(kept[1]) < len(kept[0]) and len(kept[2]) < len(kept[1]) and set(kept[3]) == set(kept[2])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {d for r in packed for d in r.doc_ids} == set(kept[3])
    encode = packing.encoder(packing.TOKENIZER)
    assert all(encode.decode(ids[:-1]) == texts[d] for d, ids in packing.unpack(packed).items())


@needed
def test_odd_tables(spark, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = cases.docs(spark, [(1, None), (2, ""), (None, "a b c"), (3, "w " * 100_000), (4, "x y z"), (4, "x y z")])
    for table in (odd, cases.empty(spark)):
        path = str(tmp_path / f"t{table.count()}")
        os.mkdir(path)
        for name in ("labels", "benchmark"):
            os.symlink(tmp_path / f"{name}.parquet", f"{path}/{name}.parquet")
        table.write.parquet(f"{path}/documents.parquet")
        rows = corpus_pipeline.run(spark, path).collect()
        ids = [d for r in rows for d in r.doc_ids]
        assert ids.count(4) <= 1 and (table is odd or not rows)


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no vocabulary here")
def test_packed_order_has_the_target_shares(spark, tmp_path):
    # A hot source outlasts the others, so what comes first must hold them by their weights.
    source = ["hot"] * 4000 + ["a"] * 250 + ["b"] * 250
    docs = cases.docs(spark, [(k, f"w{k} " * (60 if s == "hot" else 30)) for k, s in enumerate(source)], lambda k: source[k])
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    mixed = dict(corpus_pipeline.STAGES)["mixing sources to target weights"](spark, docs, "")
    path = str(tmp_path / "mixed")
    mixed.write.parquet(path)
    read = spark.read.parquet(path).repartition(3, "source")  # an order that is not the mixture's
    packed = corpus_pipeline.STAGES[-1][1](spark, read, "").collect()
    packed.sort(key=lambda r: (r.shard, r.row))
    first = {}
    for d in (d for r in packed for d in r.doc_ids):
        first.setdefault(d, len(first))
    order = [source[d] for d in sorted(first, key=first.get)]
    assert sorted(first) == list(range(len(source)))
    weight = {"hot": 4000**0.5, "a": 250**0.5, "b": 250**0.5}
    held = order[:750]  # the small sources last for 250 / 0.167 = 1,500 places
    assert all(abs(held.count(s) / 750 - w / sum(weight.values())) < 0.1 for s, w in weight.items())
    assert set(order[-1000:]) == {"hot"}
