"""Encoding in step against merging by rank, and the encoder on an empty table."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tallyho.llm import bpe, queries


@pytest.mark.parametrize("seed", range(12))
def test_words_in_step_equal_merging(seed):
    rng = np.random.default_rng(seed)
    tokens, merges = ["a", "b", "c"], []
    for _ in range(14):
        u, v = tokens[rng.integers(len(tokens))], tokens[rng.integers(len(tokens))]
        if u + v not in tokens:
            merges.append((u, v))
            tokens.append(u + v)
    made = bpe.Automaton({t: i for i, t in enumerate(tokens)}, merges)
    steps = bpe.Steps(made, "", [chr(b) for b in range(256)])
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 20))) for _ in range(300)]
    flat, ends = steps.encode([w.encode() for w in words])
    for word, a, b in zip(words, ends, ends[1:]):
        parts = list(word)
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i:i + 2] = [u + v]
                i += 1
        assert [tokens[i] for i in flat[a:b]] == parts == [tokens[i] for i in made.encode(word, "")]


def test_an_unknown_symbol_is_refused():
    steps = bpe.Steps(bpe.Automaton({"a": 0, "b": 1, "ab": 2}, [("a", "b")]), "", [chr(b) for b in range(256)])
    with pytest.raises(ValueError):
        steps.encode([b"ab", b"ax"])


def test_forgotten_words_are_encoded_again(monkeypatch):
    codec = bpe.Codec(bpe.Spec.read(queries.tokenizer_path()))
    text = "some words here <|endoftext|> and there, " + "z" * 200
    want = codec.encode(text).tolist()
    monkeypatch.setattr(bpe, "CACHED_BYTES", 0)
    for _ in range(3):
        assert codec.encode(text).tolist() == want
    assert [x.tolist() for x in codec.encode_all([None, text, "", text])] == [[], want, [], want]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_digests(docs, queries.tokenizer_path()).collect() == []
    assert bpe.encode_texts(docs, queries.tokenizer_path()).collect() == []


def test_a_batch_is_encoded_in_parts_of_bounded_memory():
    codec = bpe.Codec(bpe.Spec.read(queries.tokenizer_path()), labelled=False)
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(500)]
    texts = [None, "", *[" ".join(rng.choice(words, 2000)) for _ in range(500)], "", None]   # 7 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    want = [x.tolist() for x in codec.encode_all(texts)]
    tracemalloc.start()
    got = []
    for part in bpe._encoded(codec, iter([batch]), "text", ["doc_id", "text"]):
        got.append(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    table = pa.Table.from_batches(got)
    assert table["ids"].to_pylist() == want and table["text"].to_pylist() == texts
    assert table["doc_id"].to_pylist() == list(range(len(texts)))
    assert peak < 30e6


def test_a_codec_without_labels_keeps_none():
    codec = bpe.Codec(bpe.Spec.read(queries.tokenizer_path()), labelled=False)
    assert len(codec.encode("some words <|endoftext|> and some more")) > 4
    assert not codec.words.labels and not codec.chunks.labels


def test_forgotten_arcs_are_resolved_again(monkeypatch):
    codec = bpe.Codec(bpe.Spec.read(queries.tokenizer_path()))
    text = "forgotten arcs are resolved again, letter by letter " + "wordswithoutend" * 20
    want = codec.encode(text).tolist()
    codec = bpe.Codec(bpe.Spec.read(queries.tokenizer_path()))
    monkeypatch.setattr(bpe, "CACHED_ARCS", 5, raising=False)
    assert codec.encode(text).tolist() == want
    assert len(codec.automaton.table) <= 5
