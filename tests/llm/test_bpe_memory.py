"""What the tokenizer holds at once does not grow with the lengths of a batch's texts."""

import pyarrow as pa

from weftline.llm import bpe


def test_long_texts_are_encoded_a_few_at_a_time():
    texts = ["some words " * 2900] * 400 + ["", None, "x"]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "text": texts})
    parts = list(bpe.encode_batches([batch], *bpe.default_vocabulary(), 1))
    assert max(x.num_rows for x in parts) <= 100
    out = pa.Table.from_batches(parts)
    codec = bpe.Codec.of(*bpe.default_vocabulary())
    assert out.column("k").to_pylist() == list(range(len(texts)))
    assert [codec.decode(x).decode() for x in out.column("ids").to_pylist()] == [t or "" for t in texts]
