"""Recordings and the command line on small files."""

import io
import tarfile
import wave

import numpy as np
import pytest
from tallyspark import cli, registry
from tallyspark.sources import audio, texts


def _wave(x, rate=8000, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((x.shape[1], width, rate, 0, "NONE", ""))
        if width == 1:
            w.writeframes((x * 127 + 128).astype(np.uint8).tobytes())
        else:
            whole = (x * (2 ** (8 * width - 1) - 1)).astype("<i4")
            w.writeframes(np.ascontiguousarray(whole).view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
    return out.getvalue()


TONE = np.sin(np.arange(800) / 9)[:, None] * [0.5, 0.25]


def test_headers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.wav").write_bytes(_wave(TONE))
    (tmp_path / "in" / "b.wav").write_bytes(b"RIFF")
    (tmp_path / "short.wav").write_bytes(b"x")
    packed = 44100 << 44 | 1 << 41 | 15 << 36 | 123456
    (tmp_path / "c.wav").write_bytes(b"fLaC" + bytes([0, 0, 0, 34]) + bytes(10) + packed.to_bytes(8, "big") + bytes(16))
    got = {r.utt_id: r for r in audio.probe(texts.files(spark, str(tmp_path), ".wav")).collect()}
    assert (got["a"].frames, got["a"].rate, got["a"].channels, got["a"].duration_s, got["a"].error) == (800, 8000, 2, 0.1, None)
    assert (got["c"].frames, got["c"].rate, got["c"].channels) == (123456, 44100, 2)
    assert all(got[k].frames is None and got[k].error for k in ("b", "short"))


def test_members(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar", "w") as t:
        for name, body in (("d/s1__U__u1.wav", _wave(TONE)), ("s2.wav", b"no"), ("read.me", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    (tmp_path / "y.tar").write_bytes((tmp_path / "x.tar").read_bytes()[:1000])
    found = audio.members(texts.files(spark, str(tmp_path), "x.tar"))
    got = {r.utt_id: r for r in found.collect()}
    assert sorted(got) == ["s1__U__u1", "s2"] and got["s1__U__u1"].speaker_id == "s1" and got["s2"].speaker_id == "s2"
    rows = {r.utt_id: r for r in audio.decoded(found, 8000).collect()}
    assert np.allclose(rows["s1__U__u1"].samples, TONE.mean(1), atol=1e-4)
    assert rows["s2"].samples is None and rows["s2"].error
    assert audio.members(texts.files(spark, str(tmp_path), "y.tar")).count() == 0


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_samples(width):
    content = _wave(TONE, width=width)
    assert np.allclose(audio.mono(content, 8000), TONE.mean(1), atol=2e-2 if width == 1 else 1e-4)
    assert len(audio.mono(content, 8000, 0.05)) == 400
    fine = audio.mono(content, 16000)
    assert len(fine) == 1600 and np.allclose(fine[::2], audio.mono(content, 8000))
    assert len(audio.mono(_wave(TONE[:0], width=width))) == 0


def test_command_line(spark, tmp_path, monkeypatch):
    base = ["--model", "m", "--embeddings", str(tmp_path / "e")]
    monkeypatch.setenv(cli.CACHE, str(tmp_path / "cache"))
    assert cli.options(base).results == str(tmp_path / "cache" / "results")
    assert cli.options([*base, "--cache", "/x"]).cache == "/x"
    with pytest.raises(SystemExit):
        cli.options([*base, "--tasks", "a", "--categories", "one"])
    r = registry.Registry()
    r.add(registry.Task("a", "one", lambda s, e: e.count()))
    r.add(registry.Task("b", "two", lambda s, e: 0.5))
    spark.range(5).write.parquet(str(tmp_path / "e"))
    first = cli.main(spark, r, [*base, "--tasks", "a"]).collect()
    assert [(x.task, x.score, x.status) for x in first] == [("a", 5.0, "ok")]
    again = cli.main(spark, r, base).collect()
    assert [(x.task, x.status) for x in again] == [("a", "kept"), ("b", "ok")]
    with pytest.raises(KeyError):
        cli.main(spark, r, [*base, "--tasks", "z"])
