"""Encoding takes few texts of a large batch at a time, so that a task's memory doesn't follow the batch."""

import pyarrow as pa

from strandloom.llm import packing, tokens


def test_large_batches_are_encoded_in_parts(monkeypatch):
    asked = []
    encode = tokens.Encoder.encode
    monkeypatch.setattr(tokens.Encoder, "encode", lambda self, texts: asked.append(len(texts)) or encode(self, texts))
    texts = [None, ""] + [f"word{i} and some more words" for i in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64())] * 2 + [pa.array(texts, pa.string())], ["doc_id", "row", "text"])
    path = tokens.vocabulary_path()
    found = pa.Table.from_batches(packing._pieces(path, 4096)(iter([batch, batch.slice(0, 0)]))).to_pydict()
    assert max(asked) <= 1000
    assert found["doc_id"] == list(range(len(texts)))
    assert found["length"] == [len(c) // 4 + 1 for c in encode(tokens.Encoder(path), texts)]


def test_ids_do_not_depend_on_the_parts(monkeypatch):
    texts = [f"Word{i % 7} über naïve words, 日本 {i}" if i % 3 else f"plain words {i}!" for i in range(200)]
    path = tokens.vocabulary_path()
    whole = tokens.Encoder(path).encode(texts)
    monkeypatch.setattr(tokens, "PART_CHARS", 50)
    assert tokens.Encoder(path).encode(texts) == whole
