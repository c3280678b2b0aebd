"""Recordings: headers, members of tar files, samples (SRC04, SRC07, SRC17).

Files are opened on the executors through their URI, so only paths travel through Spark. What can't
be read gives a row with an error and nulls, and no failure.
"""

from __future__ import annotations

import io
import struct
import tarfile
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame

# What parts a member's name, and the rate that samples are brought to.
NAME_PARTS, RATE = "__U__", 16000
#: Bytes of members, or of samples, in one batch.
BATCH_BYTES = 16 << 20
PROBED = "path string, utt_id string, frames long, rate int, channels int, duration_s double, error string"
MEMBERS = "path string, member string, utt_id string, speaker_id string, content binary"
SAMPLES = "utt_id string, rate int, samples array<float>, error string"


def _opened(path: str) -> object:
    scheme, _, rest = path.partition(":")
    system, name = fs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else path)
    return system.open_input_file(name)


def header(file: object) -> tuple[int, int, int]:
    """Frames, rate and channels of a WAV or FLAC file, from its head alone. ValueError for any other."""
    head = file.read(42)
    if head[:4] == b"fLaC" and len(head) == 42:
        # 20 bits of rate, 3 of channels less one, 5 of width, 36 of frames
        packed = int.from_bytes(head[18:26], "big")
        return packed & (1 << 36) - 1, packed >> 44, (packed >> 41 & 7) + 1
    file.seek(0)
    try:
        with wave.open(file) as w:
            return w.getnframes(), w.getframerate(), w.getnchannels()
    except (wave.Error, EOFError, struct.error) as e:
        raise ValueError(f"neither WAV nor FLAC: {e}") from e


def probe(found: DataFrame) -> DataFrame:
    """path, utt_id, frames, rate, channels, duration_s and error of each file (``found``: path, utt_id); no samples are read. Without a rate a file has no duration."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            rows = []
            for path, utt in zip(part["path"], part["utt_id"], strict=True):
                try:
                    with _opened(path) as f:
                        n, rate, channels = header(f)
                    rows.append((path, utt, n, rate, channels, n / rate if rate else None, None))
                except (OSError, ValueError) as e:
                    rows.append((path, utt, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "utt_id", "frames", "rate", "channels", "duration_s", "error"]).astype({"frames": "Int64", "rate": "Int32", "channels": "Int32"})

    return found.select("path", "utt_id").mapInPandas(run, PROBED)


def members(found: DataFrame, suffix: str = ".wav") -> DataFrame:
    """The files of that suffix in each tar file (``found``: path), read as a stream: utt_id is the name without folders and suffix, speaker_id what stands before NAME_PARTS in it.

    A tar file that breaks off gives the members before the break.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (p for part in frames for p in part["path"]):
            rows, size = [], 0
            try:
                with _opened(path) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
                    for m in tar:
                        if not m.isfile() or not m.name.endswith(suffix):
                            continue
                        name = m.name.rsplit("/", 1)[-1].removesuffix(suffix)
                        content = tar.extractfile(m).read()
                        rows.append((path, m.name, name, name.split(NAME_PARTS)[0], content))
                        size += len(content)
                        if size > BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=["path", "member", "utt_id", "speaker_id", "content"])
                            rows, size = [], 0
            except (tarfile.TarError, OSError):
                pass
            yield pd.DataFrame(rows, columns=["path", "member", "utt_id", "speaker_id", "content"])

    return found.select("path").mapInPandas(run, MEMBERS)


def mono(content: bytes, rate: int = RATE, most_s: float | None = None) -> np.ndarray:
    """Samples of a PCM WAV file between -1 and 1: the mean of its channels, cut after ``most_s`` seconds, at ``rate`` by linear interpolation."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
        n = w.getnframes() if most_s is None else min(w.getnframes(), int(most_s * own))
        raw = w.readframes(n)
    raw = np.frombuffer(raw, np.uint8)[: len(raw) // (width * channels) * width * channels].reshape(-1, width)
    if width == 1:
        x = raw[:, 0].astype(np.float64) / 128 - 1
    else:
        # the low bytes of a 32-bit number stay empty
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 4 - width :] = raw
        x = wide.view("<i4")[:, 0] / 2.0**31
    x = x.reshape(-1, channels).mean(1)
    if own != rate and len(x):
        x = np.interp(np.arange(int(len(x) * rate / own)) * (own / rate), np.arange(len(x)), x)
    return x.astype(np.float32)


def decoded(rows: DataFrame, rate: int = RATE, most_s: float | None = None) -> DataFrame:
    """utt_id, rate, samples and error of each row's ``content``; a null or unreadable one has an error and no samples."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            out, size = [], 0
            for utt, content in zip(part["utt_id"], part["content"], strict=True):
                try:
                    x = mono(content or b"", rate, most_s)
                    out.append((utt, rate, x, None))
                    size += x.nbytes
                except (wave.Error, EOFError, ValueError, struct.error) as e:
                    out.append((utt, rate, None, f"{type(e).__name__}: {e}"[:200]))
                if size > BATCH_BYTES:
                    yield pd.DataFrame(out, columns=["utt_id", "rate", "samples", "error"])
                    out, size = [], 0
            yield pd.DataFrame(out, columns=["utt_id", "rate", "samples", "error"])

    return rows.select("utt_id", "content").mapInPandas(run, SAMPLES)
