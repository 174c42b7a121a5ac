"""WAV files in blocks: the samples of the whole files, however they are divided."""

import wave

import numpy as np
import pytest

from weftline.sources import audio, readers


def written(path, rate, channels, width, frames, seed):
    x = np.random.default_rng(seed).integers(0, 256, frames * channels * width, dtype=np.uint8).tobytes()
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(x)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("wav")
    for k, (rate, channels, width, frames) in enumerate([(8000, 1, 2, 20_000), (16_000, 2, 2, 5001), (8000, 1, 3, 777), (8000, 2, 1, 64), (8000, 1, 4, 1), (8000, 1, 2, 0)]):
        written(at / f"r{k}.wav", rate, channels, width, frames, k)
    (at / "other.txt").write_text("no recording")
    return at


@pytest.mark.parametrize("part, block", [(1 << 25, 1 << 16), (5000, 512), (100, 7), (44, 64)])
def test_blocks_are_the_whole_files(spark, folder, part, block):
    whole = {r["id"]: r for r in readers.wav(spark, str(folder)).collect()}
    blocks = audio.wav_blocks(spark, str(folder), partBytes=str(part), blockFrames=str(block))
    if part == 5000:
        assert audio.wav_blocks(spark, f"{folder}/r0.wav", partBytes="5000").rdd.getNumPartitions() > 6
    got = {}
    for r in blocks.orderBy("id", "channel", "block").collect():
        own = got.setdefault(r["id"], [])
        assert r["frames"] * r["channels"] == len(whole[r["id"]]["samples"]) and r["samp_freq"] == whole[r["id"]]["samp_freq"]
        assert r["block"] * block + r["channel"] * r["frames"] == len(own)
        own += r["samples"]
    assert {k: v["samples"] for k, v in whole.items() if v["samples"]} == got


def test_headers_and_patterns(spark, folder):
    rows = {r["id"]: (r["samp_freq"], r["channels"], r["frames"]) for r in audio.wav_blocks(spark, str(folder), headers="true").collect()}
    assert rows == {"r0": (8000, 1, 20_000), "r1": (16_000, 2, 5001), "r2": (8000, 1, 777), "r3": (8000, 2, 64), "r4": (8000, 1, 1), "r5": (8000, 1, 0)}
    assert {r["id"] for r in audio.wav_blocks(spark, f"{folder}/r[13]*.wav").select("id").collect()} == {"r1", "r3"}
    assert {r["id"] for r in audio.wav_blocks(spark, f"{folder}/r2.wav").select("id").collect()} == {"r2"}
    both = audio.wav_blocks(spark, str(folder))
    assert {r["id"] for r in both.filter("id = 'r1'").select("id").collect()} == {"r1"} and both.select("id").distinct().count() == 5
    assert audio.wav_blocks(spark, f"{folder}/none*.wav").count() == 0
    (folder / "bad.wav").write_bytes(b"RIFFxxxxWAVEjunk")
    with pytest.raises(Exception, match="without samples"):
        audio.wav_blocks(spark, f"{folder}/bad.wav").collect()
    (folder / "bad.wav").unlink()


def test_segments_cut_from_blocks(spark, folder):
    segments = spark.createDataFrame([("r0", 0, 0.1, 1.3), ("r0", 1, 1.0, 9.9), ("r0", 2, 2.0, 2.0), ("r1", 0, 0.0, 0.25), ("r1", 1, 0.3, 0.4), ("r2", 0, 0.05, 0.0501), ("none", 0, 0.0, 1.0)], "rec string, seg int, start double, end double")
    whole = {(r["rec"], r["seg"]): (r["samples"], r["rms"]) for r in readers.cut_audio(readers.wav(spark, str(folder)), segments, None).collect()}
    for block in (100, 4096):
        got = {(r["rec"], r["seg"]): (r["samples"], r["rms"]) for r in audio.cut_blocks(spark, str(folder), segments, None, block, partBytes="3000").collect()}
        assert got == whole
    assert audio.cut_blocks(spark, str(folder), segments, 100.0).count() == 0
