"""Token coders, packing, id files and BPE against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from dyadic.llm import bpe, packing, simple8b
from dyadic.llm.common import tokenizer_file
from dyadic.llm.tokens import ByteCoder, WordCoder


def _random_texts(n=1500):
    rnd = random.Random(1)
    return ["".join(rnd.choice("ab \n.é'st9\t\x01ΣÉ\x85") for _ in range(rnd.randrange(60))) for _ in range(n)]


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y\n<|endoftext|><|endoftext|>", "<|EndOfText|> <|endoftext",
           "tab\t<|endoftext|>\x85", "<|endof text|> <|startoftext|>"]


def _direct(file):
    tok = Tokenizer.from_file(tokenizer_file(file))
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kind,file", [(WordCoder, "word_bpe_49k.json"), (ByteCoder, "byte_bpe_50k.json")])
def test_chunks_give_the_ids_of_whole_texts(kind, file, edge_texts, monkeypatch):
    from dyadic.llm import tokens
    monkeypatch.setattr(tokens, "GROUP_BYTES", 3000)
    monkeypatch.setattr(tokens, "CHUNKS", 50)
    coder, direct = kind(tokenizer_file(file), entries=40), _direct(file)
    texts = edge_texts + _random_texts() + SPECIAL
    for t, ids in zip(texts, coder.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == direct(t), t


def test_lone_pieces_of_any_length(monkeypatch):
    enc, rnd = _tiktoken(), random.Random(8)
    vocab = bpe.Vocabulary(tokenizer_file("byte_bpe_50k.tiktoken"))
    pieces = ["".join(rnd.choice(letters) for _ in range(n)) for letters in ("ab", "thequickbrownfox", "é日xΣ")
              for n in (2, 3, 4, 5, 31, 32, 33, 700)]
    for p in pieces:
        want = np.array(enc.encode_ordinary(p), "<u4").tobytes()
        raw = p.encode()
        assert bpe.merge_alone(vocab, raw) == want
        assert bpe.merge_side_by_side(vocab, [raw], 1 << (len(raw) - 1).bit_length()) == [want]


def test_texts_of_a_megabyte(docs_of):
    """One letter run, and long prose: results equal the libraries'."""
    rnd = random.Random(9)
    run = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    prose = " ".join(rnd.choices(["alpha", "Beta,", "gamma.\n", "123", "été"], k=170_000))
    enc = _tiktoken()
    got = {r["n_tokens"]: r["ids_sha256"] for r in bpe.encode_texts(docs_of([run, prose])).collect()}
    want = [enc.encode_ordinary(t) for t in (prose,)]
    pieces = [run[i:i + 20_000] for i in range(0, len(run), 20_000)]
    assert hashlib.sha256(np.array(want[0], "<u4").tobytes()).hexdigest() in got.values()
    ids = np.frombuffer(bpe.merge_alone(bpe.Vocabulary(tokenizer_file("byte_bpe_50k.tiktoken")), pieces[0].encode()), "<u4")
    assert ids.tolist() == enc.encode_ordinary(pieces[0])
    for kind, file in ((WordCoder, "word_bpe_49k.json"), (ByteCoder, "byte_bpe_50k.json")):
        assert kind(tokenizer_file(file)).encode(pa.array([prose]))[0].tolist() == _direct(file)(prose)


def _tiktoken():
    with open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_decodes(docs_of, edge_texts):
    texts = edge_texts + _random_texts(400) + ["ab" * 3000, "q" * 5000]
    enc = _tiktoken()
    got = bpe.encode_texts(docs_of(texts), keep_ids=True).drop("doc_id").collect()
    want = []
    for t in texts:
        ids = enc.encode_ordinary(t or "")
        want.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids)))
    assert sorted((r[0], r[1], r[2], tuple(r[3])) for r in got) == sorted(want)


@pytest.mark.parametrize("top", [1, 2, 5, 100, 4096, 50257, 1 << 25, 1 << 40, 1 << 62])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 7, 61, 1000):
        v = rng.integers(0, top, n, dtype=np.uint64)
        v[n // 3:n // 2] = 1
        v[-1:] = top - 1
        assert (simple8b.decode_block(simple8b.encode_block(v), n) == v).all()


def test_simple8b_words_hold_the_longest_run():
    assert len(simple8b.encode_block(np.ones(60, np.uint64))) == 1
    assert len(simple8b.encode_block(np.full(4, (1 << 15) - 1, np.uint64))) == 1
    assert len(simple8b.encode_block(np.array([1 << 61], np.uint64))) == 2  # an escape and the raw word


def test_id_files_read_back(spark, docs_of, edge_texts, monkeypatch):
    monkeypatch.setattr(simple8b, "BLOCK", 100)
    direct = _direct("byte_bpe_50k.json")
    texts = edge_texts + _random_texts(100) + SPECIAL
    docs = docs_of(texts)
    got = simple8b.id_files(spark, docs.union(docs.limit(1)), keep_ids=True).collect()
    rows = sorted(got, key=lambda r: r["start"])
    at, key = 0, []
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
        key.append(-1 if r["doc_id"] is None else r["doc_id"])
    assert key == sorted(key) and len(rows) == len(texts) + 1
    want = sorted([*direct(t), 0] for t in texts)
    have = sorted(r["ids"] for r in rows)
    assert all(w in have for w in want)
    assert simple8b.id_files(spark, docs.limit(0)).count() == 0


def test_rows_of_one_id_span_files_in_order(spark, monkeypatch):
    direct = _direct("byte_bpe_50k.json")
    rows = [(i // 3 if i < 90 else 7, f"word {i} " * (i % 5), "clash") for i in range(300)] + [(None, "no id", "clash")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = simple8b.write_ids(docs, simple8b.scratch_path(spark, "ids"))
        got = sorted(simple8b.read_ids(files, keep_ids=True).collect(), key=lambda r: r["start"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 2
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert sorted((k, r["ids"]) for k, r in zip(ids, got, strict=True)) == sorted(
        (-1 if i is None else i, [*direct(t), 0]) for i, t, _ in rows)


def test_a_cut_file_is_refused(tmp_path):
    w = simple8b.FileWriter(str(tmp_path / "a.s8"))
    w.add([1], [3], np.arange(3, dtype=np.uint64))
    w.close()
    assert [x.tolist() for x in simple8b.FileReader(str(tmp_path / "a.s8")).documents()] == [[0, 1, 2]]
    (tmp_path / "b.s8").write_bytes((tmp_path / "a.s8").read_bytes()[:-9])
    with pytest.raises(ValueError):
        simple8b.FileReader(str(tmp_path / "b.s8"))


def test_packing_is_gapless_and_tight(docs_of, edge_texts):
    direct = _direct("word_bpe_49k.json")
    rnd = random.Random(2)
    texts = edge_texts + SPECIAL + [" ".join(rnd.choice(["the", "quick", "fox"]) for _ in range(rnd.randrange(400))) for _ in range(150)]
    docs = docs_of(texts)
    cap = 128
    out = [r.asDict() for r in packing.packed_sequences(docs, capacity=cap, keep_ids=True).collect()]
    bins = {}
    for r in out:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= cap
    total = sum(r["length"] for r in out)
    assert total == sum(len(direct(t)) + 1 for t in texts)
    assert len(bins) <= -(-total // cap) + 1
    assert packing.packed_sequences(docs.limit(0)).count() == 0


def test_fullest_bin_is_optimal():
    rnd = random.Random(4)
    for _ in range(200):
        have = {rnd.randrange(1, 30): rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 6))}
        room = rnd.randrange(1, 60)
        sums = {0}
        for x, n in have.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        got = packing.fullest(have, room)
        assert all(got[x] <= have[x] for x in got)
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)


def test_id_tasks_hold_few_texts_and_give_memory_back(spark, tmp_path, monkeypatch):
    """A large Arrow batch is encoded in small slices, and a worker hands freed
    memory back at the end of each task that writes or reads ids."""
    from types import SimpleNamespace
    tasks, held, freed = [], [], []
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: (tasks.append(run), df)[1])
    monkeypatch.setattr(simple8b, "stored", lambda df, name: df)
    monkeypatch.setattr(simple8b, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    encode = ByteCoder.encode
    monkeypatch.setattr(ByteCoder, "encode", lambda c, texts: (held.append(len(texts)), encode(c, texts))[1])
    for module in (simple8b, packing):
        monkeypatch.setattr(module, "release_memory", lambda: freed.append(1))
    texts = [f"text {i}" for i in range(8000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(8000), pa.int64()), "text": texts})
    simple8b.write_ids(docs, str(tmp_path))
    (written,) = tasks.pop()(iter([batch]))
    assert max(held) <= 2000 and sum(held) == 8000 and len(freed) == 1
    simple8b.read_ids(spark.createDataFrame([(0, written.column(1)[0].as_py(), 8000, 0)], "part int, file string, n_docs long, n_ids long"))
    files = pa.RecordBatch.from_pydict({"file": written.column(1), "before": pa.array([0], pa.int64())})
    assert sum(b.num_rows for b in tasks.pop()(iter([files]))) == 8000 and len(freed) == 2
