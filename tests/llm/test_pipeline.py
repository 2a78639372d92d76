"""The pipeline's stages one by one and as a whole."""

import random

import corpus_pipeline
from dyadic.llm import quality

from test_records_and_rules import WORDS


def _corpus():
    rnd = random.Random(8)
    vocab = {k: v.split() + [f"{v[:3].strip()}{i}{k}" for i in range(900)] for k, v in WORDS.items()}
    texts, langs = [], []

    def add(text, lang):
        texts.append(text)
        langs.append(lang)

    for i in range(120):
        lang = list(WORDS)[i % 4]
        words = rnd.choices(vocab[lang], k=rnd.randrange(60, 200))
        add(" ".join(words), lang)
        if i % 6 == 0:
            copy = words[:]
            copy[5] = "changed"
            add(" ".join(copy), lang)
        if i % 10 == 0:
            add(" ".join(words), lang)
    shared = " ".join(rnd.choices(vocab["en"], k=70))
    for _ in range(4):
        add(" ".join(rnd.choices(vocab["en"], k=80)) + " " + shared + " " + " ".join(rnd.choices(vocab["en"], k=80)), "en")
    for t in (None, "", "123 456", "too short", "spam words again and again here " * 30):
        add(t, None)
    return texts, langs, shared


def test_stages(spark, docs_of, tmp_path):
    texts, langs, shared = _corpus()
    docs = docs_of(texts, langs).drop("length", "score", "c")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_copies", "repeated_passages", "packing"]
    now, left = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == docs.columns
        left.append([r[0] for r in now.select("text").collect()])
    known, good, single, cut = left
    assert sorted(known) == sorted(t for t in texts if t and any(map(str.isalpha, t)))
    bits = {r["text"]: r["kept"] for r in quality.apply_policy(quality.ledger(
        spark.createDataFrame([(t, t) for t in known], "doc_id string, text string"))).withColumnRenamed("doc_id", "text").collect()}
    assert sorted(good) == sorted(t for t in known if bits[t]) and len(good) == len(texts) - 5
    assert len(single) == 124 and len(set(single)) == 124
    assert sum(shared in t for t in single) == 4 and not any(shared in t for t in cut)
    assert sorted(t for t in single if shared not in t) == sorted(t for t in cut if t in set(single))
    (tmp_path / "in").mkdir()
    docs.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path / "in")).collect()
    assert len({r["doc_id"] for r in packed}) <= len(cut) == len({(r["doc_id"], r["ids_crc32"], r["piece"]) for r in packed})
    total = sum(r["length"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) == -(-total // 4096)


def test_empty_documents(spark, docs_of, tmp_path):
    docs = docs_of(["x"]).limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
