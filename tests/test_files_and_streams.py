"""Round trips of the file formats, and the streaming forms."""

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.sources import readers, sinks


def test_wav(spark, tmp_path):
    x = (np.sin(np.arange(1600) / 10) * 20000).astype("<i2")
    with wave.open(str(tmp_path / "r1.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(16000)
        f.writeframes(x.tobytes())
    one = readers.wav(spark, str(tmp_path)).first()
    assert (one["id"], one["samp_freq"], one["length_s"]) == ("r1", 16000, 0.1) and np.allclose(one["samples"], x / 32768)
    segs = spark.createDataFrame([("r1", 0, 0.0, 0.05), ("r1", 1, 0.5, 0.6)], "rec string, seg int, start double, end double")
    cut = readers.cut_audio(readers.wav(spark, str(tmp_path)), segs).collect()
    assert [len(r["samples"]) for r in cut] == [800]


def test_recognised_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"s1": {"reco_id": "a", "start": 10.0, "end": 12.0, "text": "x y", "chunks": [{"text": "x", "timestamp": [0.0, 0.5]}, {"text": "y", "timestamp": [1, 1.5]}]}, "s2": {"reco_id": "a", "start": 20.0, "end": 21.0, "text": "z"}}))
    assert [(r["pos"], r["word"], r["start"]) for r in readers.recognised_map(spark, str(tmp_path / "a.json")).orderBy("pos").collect()] == [(0, "x", 10.0), (1, "y", 11.0)]
    (tmp_path / "b.json").write_text(json.dumps([{"start": 0, "end": 1, "text": "x y z", "words": [{"start": 0.1, "end": 0.2}, {"start": 0.3, "end": 0.4}]}]))
    assert [r["word"] for r in readers.recognised_list(spark, str(tmp_path / "b.json")).orderBy("pos").collect()] == ["x", "y"]


def test_transcripts(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("u1\tAla [x] ma\nbad line\n\n")
    good, bad = readers.transcript_lines(spark, str(tmp_path / "t.tsv"))
    assert [tuple(r) for r in good.collect()] == [("u1", "Ala [x] ma", "ala ma")] and bad.count() == 1
    (tmp_path / "n.json").write_text(json.dumps([{"uid": "u", "text": "A b", "norm": "a b", "normoff": [[0, 1], [2, 3]]}]))
    lines = readers.normalised_lines(spark, str(tmp_path / "n.json"))
    assert lines.first()["normoff"][1]["s"] == 2 and [r["word"] for r in readers.line_words(lines).orderBy("pos").collect()] == ["a", "b"]
    (tmp_path / "p.txt").write_text("c d\n e")
    assert readers.transcript(spark, str(tmp_path / "n.json")).first()["words"] == ["a", "b"]
    assert readers.transcript(spark, str(tmp_path / "p.txt")).first()["words"] == ["c", "d", "e"]


def test_small_files(spark, tmp_path):
    (tmp_path / "lm.arpa").write_text("\\data\\\nngram 1=3\n\n\\1-grams:\n-1 <s> 0\n-1 foo -0.1\n-2 bar\n\n\\2-grams:\n-1 foo bar\n")
    assert [r["word"] for r in readers.arpa_unigrams(spark, str(tmp_path / "lm.arpa")).collect()] == ["foo", "bar"]
    (tmp_path / "v.json").write_text('{"B": 1, "a": 0, "|": 2}')
    assert [tuple(r) for r in readers.tokenizer_vocabulary(spark, str(tmp_path / "v.json"), {"|": " "}, True).collect()] == [("a", 0), ("b", 1), (" ", 2)]
    vocab = spark.createDataFrame([(1, "x"), (0, "<unk>")], "id int, word string")
    sinks.write_vocabulary(vocab, str(tmp_path / "vocab"))
    assert {tuple(r) for r in readers.vocabulary(spark, str(tmp_path / "vocab")).collect()} == {(0, "<unk>"), (1, "x")}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_vocabulary(vocab, str(tmp_path / "vocab"))
    assert readers.settings(spark, str(tmp_path / "none.json"), {"a": "1"}) == {"a": "1"}
    (tmp_path / "p.json").write_text("[[0.5, 1.5], [2, 3]]")
    assert [(r["seg"], r["start"]) for r in readers.voiced_pairs(spark, str(tmp_path / "p.json")).collect()] == [(0, 0.5), (1, 2.0)]


def test_documents_and_textgrid(spark):
    df = spark.createDataFrame([(1, 1, "b", None), (1, 0, "a", 2.5)], "rec int, n int, t string, x double")
    assert json.loads(sinks.json_document(df, "rec", ["n"], ["t", "x"]).first()["document"]) == [{"t": "a", "x": 2.5}, {"t": "b"}]
    words = spark.createDataFrame([("r", 0.5, 1.0, 'a"b'), ("r", 1.0, 2.0, "c")], "rec string, start double, end double, word string")
    grid = sinks.textgrid(words, "rec").first()["value"]
    assert "size = 3" in grid and 'text = "a""b"' in grid and grid.count("xmax = 2.000") == 3


def test_files_of_recordings(spark, tmp_path):
    """One file for each recording, written and read back."""
    segs = spark.createDataFrame([("r 1", "s2", 16000.0, 9, -3.0, 5.0, 6.0, [("c", 5.0, 5.5)]), ("r 1", "s1", 16000.0, 9, -3.0, 1.0, 3.0, [("a", 1.0, 1.5), ("b", 2.0, 2.5)]), ("q", "s1", 16000.0, 9, None, 0.0, 1.0, [])], "rec string, seg string, samp_freq double, length long, rms double, start double, end double, words array<struct<word:string,start:double,end:double>>")
    sinks.write_recognition(segs, str(tmp_path / "reco"))
    got = readers.recognised_map(spark, str(tmp_path / "reco")).orderBy("rec", "pos").collect()
    assert [(r["rec"], r["pos"], r["word"], r["start"]) for r in got] == [("r 1", 0, "a", 1.0), ("r 1", 1, "b", 2.0), ("r 1", 2, "c", 5.0)]
    body = json.loads(sinks.recognition_documents(segs).filter("rec = 'r 1'").first()["document"])
    assert list(body) == ["s1", "s2"] and body["s1"]["text"] == "a b" and body["s1"]["chunks"][1]["timestamp"] == [1.0, 1.5]
    df = spark.createDataFrame([("x", 1, "b"), ("x", 0, "a"), ("y", 0, "c")], "rec string, n int, t string")
    sinks.write_json_documents(df, "rec", ["n"], ["n", "t"], str(tmp_path / "docs"))
    assert {f.parent.name: json.loads(f.read_text()) for f in (tmp_path / "docs").glob("rec=*/*.txt")} == {"rec=x": [{"n": 0, "t": "a"}, {"n": 1, "t": "b"}], "rec=y": [{"n": 0, "t": "c"}]}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_json_documents(df, "rec", ["n"], ["n", "t"], str(tmp_path / "docs"))


def test_npz_and_batches(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.savez(tmp_path / "rec7.npz", x)
    assert [(r["rec_id"], r["t"], r["logits"]) for r in readers.logits_npz(spark, str(tmp_path)).orderBy("t").collect()] == [("rec7", t, x[t].tolist()) for t in range(4)]
    df = spark.createDataFrame([(1, i, [float(i)] * n) for i, n in enumerate((1, 3, 2))] + [(2, 0, [])], "rec int, n int, x array<double>")
    got = {(r["rec"], r["n"]): (r["batch"], r["x"], r["mask"]) for r in sinks.padded_batches(df, "rec", ["n"], "x", 2).collect()}
    assert got == {(1, 0): (0, [0.0, 0.0, 0.0], [1, 0, 0]), (1, 1): (0, [1.0] * 3, [1] * 3), (1, 2): (1, [2.0] * 2, [1] * 2), (2, 0): (0, [], [])}


def test_ranges(spark):
    from weftline.functions import text as tx

    cases = {"bytes=0-9": (0, 10, 206), "bytes=90-": (90, 100, 206), "bytes=-5": (95, 100, 206), "bytes=50-500": (50, 100, 206), "bytes=100-": (100, 100, 416), "bytes=9-3": (9, 9, 416), "nonsense": (0, 100, 200), None: (0, 100, 200)}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r["h"]: tuple(r["r"]) for r in df.select("h", tx.byte_range(F.col("h"), F.lit(100).cast("bigint")).alias("r")).collect()} == cases


def test_streams(spark, tmp_path):
    from weftline.streaming import sessions

    t = [100, 105, 130, 131, 600]
    df = spark.createDataFrame([(1, float(x), x + 2.0) for x in t], "rec int, start double, end double").withColumn("at", F.timestamp_seconds("start"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sessions.session_groups(stream, "rec", "at", "10 seconds", "1 second").writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["n"]) for r in spark.table("sessions").collect()} == {2}
    q = sessions.exact_groups(stream, "rec", "at", "start", "end", 10.0, "1 second").writeStream.format("memory").queryName("exact").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["start"], r["end"], r["n"]) for r in spark.table("exact").collect()} >= {(100.0, 107.0, 2), (130.0, 133.0, 2)}


def test_plain_transcripts_and_norm_text(spark, tmp_path):
    """Plain transcripts as words; normalised text as one line for each utterance, in order."""
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text("  Ala\u00a0ma kota,\n\n i psa \n", encoding="utf-8")
    (tmp_path / "t" / "two.txt").write_text("", encoding="utf-8")
    got = {r["rec"]: r["words"] for r in readers.transcript_text(spark, str(tmp_path / "t")).collect()}
    assert got == {"one": ["Ala", "ma", "kota,", "i", "psa"]}
    lines = spark.createDataFrame([("b", 1, "third"), ("a", 10, "second é"), ("a", 2, "first"), ("b", 3, "")], "rec string, line int, norm string").repartition(3)
    sinks.write_norm_text(lines, str(tmp_path / "norm"))
    files = sorted(p for p in (tmp_path / "norm").glob("part-*"))
    assert "".join(p.read_text(encoding="utf-8") for p in files) == "first\nsecond é\nthird\n\n"
    with pytest.raises(Exception, match="exist"):
        sinks.write_norm_text(lines, str(tmp_path / "norm"))


def test_segments_without_reference_only_or_time(spark):
    """Only those of the reference alone go, not those without an error; and those that take no time."""
    from weftline.operators import sequence, stats

    segs = spark.createDataFrame([(1, None, 0.0, 1.0), (2, "only in reference", None, None), (3, "only in reco", 2.0, 2.0), (4, None, 3.0, 2.5)], "id int, match_error string, start double, end double")
    assert sorted(r["id"] for r in stats.without_reference_only(segs).collect()) == [1, 3, 4]
    assert [r["id"] for r in sequence.timed_only(segs).collect()] == [1]


def test_outside_model(spark):
    """A model is loaded in each worker and maps batches of rows."""

    def model(batches):
        loaded = {"a": "A"}
        for b in batches:
            yield b.assign(text=b["x"].map(lambda v: loaded.get(v, "?")))[["x", "text"]]

    df = spark.createDataFrame([("a",), ("b",)], "x string")
    assert sorted(tuple(r) for r in readers.with_model(df, model, "x string, text string").collect()) == [("a", "A"), ("b", "?")]


def test_rows_without_times(spark):
    from weftline.operators import sequence

    df = spark.createDataFrame([(1, 0, None, 5.0), (1, 1, 1.0, 2.0), (1, 2, 1.5, None), (1, 3, 2.0, 3.0), (1, 4, 30.0, 31.0)], "rec int, pos int, s double, e double")
    assert sorted(r["pos"] for r in sequence.greedy_keep(df, "rec", "s", "e", ["s", "pos"]).collect()) == [1, 3, 4]
    assert sorted((r["beg"], r["end"]) for r in sequence.gap_chunks(df, "rec", "pos", "s", "e", 15.0, 1, 10).collect()) == [(1, 4), (4, 5)]
    parts = {r["pos"]: r["part"] for r in sequence.split_long(df, ["rec"], "s", "e", 10.0, ["s", "pos"]).collect()}
    assert parts.keys() == {0, 1, 2, 3, 4} and parts[1] == parts[3] == 0
