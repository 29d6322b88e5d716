"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM in WAVE.

The codes of the G.711 laws are expanded through tables of 256 samples, ADPCM
blocks are decoded with numpy across all blocks at once (a step of the loop is
one sample of every block), and 16-bit PCM is resampled by a windowed-sinc
polyphase filter. The codes themselves are the lossless payload: a stored WAVE
file gives them back byte for byte.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import slices, written

MULAW, ALAW, ADPCM = 7, 6, 0x11  # WAVE format tags
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "ima_adpcm"}
RATE = 8000
BLOCK = 64  # bytes of an ADPCM block, and what payloads are padded to
TAPS = 8  # of the resampler, on each side of a sample
PIECE = 1 << 18  # codes of one file decoded at once
TOGETHER = 1 << 14  # ADPCM blocks decoded at once

# IMA ADPCM's index changes; its 89 step sizes grow by a tenth from 7.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, segment = (code & 0x0F) << 4, (code & 0x70) >> 4
    size = np.where(segment == 0, part + 8, part + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _steps() -> np.ndarray:
    """The standard's rounding of 7 * 1.1 ** k, by its integer recurrence."""
    exact = 7.0 * 1.1 ** np.arange(89)
    # The standard's table.
    table = "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767"
    steps = np.array(table.split(), np.int32)
    assert len(steps) == 89 and np.all(np.abs(steps / exact - 1) < 0.1)
    return steps


LAW = {MULAW: _mulaw_table(), ALAW: _alaw_table()}
STEPS = _steps()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(block, byte) of uint8 -> (block, sample) of int16: the header's sample,
    then two for each byte, low nibble first."""
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((len(blocks), 1 + 2 * (blocks.shape[1] - 4)), np.int16)
    out[:, 0] = sample
    for k in range(4, blocks.shape[1]):
        for half, nibble in enumerate((blocks[:, k] & 15, blocks[:, k] >> 4)):
            step = STEPS[index]
            change = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
            sample = np.clip(np.where(nibble & 8, sample - change, sample + change), -32768, 32767)
            index = np.clip(index + INDEX_STEP[nibble], 0, 88)
            out[:, 1 + 2 * (k - 4) + half] = sample
    return out


def encode(payload: bytes, tag: int, rate: int = RATE) -> bytes:
    """A WAVE file whose data are these codes. ADPCM needs whole blocks."""
    if tag == ADPCM and len(payload) % BLOCK:
        raise ValueError(f"ADPCM payloads are whole blocks of {BLOCK} bytes")
    align, bits = (BLOCK, 4) if tag == ADPCM else (1, 8)
    per_block = 1 + 2 * (BLOCK - 4)
    extra = struct.pack("<HH", 2, per_block) if tag == ADPCM else struct.pack("<H", 0)
    per_second = rate * BLOCK // per_block if tag == ADPCM else rate
    form = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + extra
    samples = len(payload) // BLOCK * per_block if tag == ADPCM else len(payload)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples)
    chunks += b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read(media: bytes) -> tuple[int, int, int, memoryview]:
    """(format tag, rate, block align, codes) of a WAVE file."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            tag, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", view, at + 8)
            if tag not in NAMES or channels != 1:
                raise ValueError(f"format {tag} with {channels} channels is not telephony audio")
            form = tag, rate, align
        elif name == b"data" and form:
            if at + 8 + size > len(view):
                raise ValueError("the data end early")
            return *form, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no format or data")


def samples(files: list[tuple[int, int, int, memoryview]]) -> list[Iterable[np.ndarray]]:
    """The PCM of files as ``read`` gives them, each in pieces of bounded size.
    ADPCM blocks are decoded together, whichever file they are from; a file
    larger than a piece is decoded as its pieces are asked for."""

    def pieces(tag: int, align: int, data: np.ndarray) -> Iterator[np.ndarray]:
        step = PIECE // align * align
        for at in range(0, len(data), step):
            piece = data[at : at + step]
            yield decode_adpcm(piece.reshape(-1, align)).ravel() if tag == ADPCM else LAW[tag][piece]

    data = [np.frombuffer(codes, np.uint8) for *_, codes in files]
    found: list[Iterable[np.ndarray]] = [pieces(tag, align, d) for (tag, _, align, _), d in zip(files, data, strict=True)]
    for size in {align for tag, _, align, _ in files if tag == ADPCM}:
        own = [k for k, (tag, _, align, _) in enumerate(files) if tag == ADPCM and align == size and len(data[k]) <= PIECE]
        blocks = np.concatenate([data[k] for k in own] or [np.zeros(0, np.uint8)]).reshape(-1, size)
        pcm = np.concatenate([decode_adpcm(blocks[at : at + TOGETHER]) for at in range(0, max(1, len(blocks)), TOGETHER)])
        ends = np.cumsum([len(data[k]) // size for k in own])
        for k, end in zip(own, ends, strict=True):
            found[k] = [pcm[end - len(data[k]) // size : end].ravel()]
    return found


def _filters(up: int, down: int) -> np.ndarray:
    """(phase, tap): windowed sincs that pass what both rates can hold."""
    cut = min(1.0, up / down)
    t = np.arange(-TAPS + 1, TAPS + 1)[None, :] - np.arange(up)[:, None] / up
    taps = cut * np.sinc(cut * t) * np.cos(np.pi * t / (2 * TAPS + 1)) ** 2
    return taps / taps.sum(axis=1, keepdims=True)


def resample(pieces: Iterable[np.ndarray], rate: int, to: int) -> Iterator[np.ndarray]:
    """int16 PCM at another rate, in pieces that join without a seam. The ends
    are continued with silence."""
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    filters = _filters(up, down)
    kept, begin, count, done = np.zeros(TAPS - 1), -(TAPS - 1), 0, 0  # samples held, where they begin, samples seen, samples given
    for piece in pieces:
        kept = np.concatenate([kept, piece])
        count += len(piece)
        last = ((count - TAPS) * up - 1) // down  # the last that needs nothing more
        if last >= done:
            yield _at(kept, begin, filters, np.arange(done, last + 1), up, down)
            done = last + 1
            keep = done * down // up - TAPS + 1
            kept, begin = kept[keep - begin :], keep
    end = -(-count * up // down)
    if end > done:
        yield _at(np.concatenate([kept, np.zeros(TAPS + 1)]), begin, filters, np.arange(done, end), up, down)


def _at(kept: np.ndarray, begin: int, filters: np.ndarray, n: np.ndarray, up: int, down: int) -> np.ndarray:
    out = np.zeros(len(n))
    for first in range(min(up, len(n))):  # samples of one phase are evenly spaced in the input
        own = n[first::up]
        start, taps, many = own[0] * down // up - TAPS + 1 - begin, filters[own[0] * down % up], len(own)
        for k, tap in enumerate(taps):
            out[first::up] += tap * kept[start + k : start + k + (many - 1) * down + 1 : down]
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def pcm_wave(pieces: Iterable[np.ndarray], rate: int) -> bytes:
    """A WAVE file of 16-bit PCM."""
    data = b"".join(p.astype("<i2").tobytes() for p in pieces)
    form = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def tag_of(payload: bytes) -> int:
    """The codec that a payload is stored with: each takes its turn by the checksum."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def store(docs: DataFrame, pad: int = BLOCK) -> DataFrame:
    """doc_id, text -> (doc_id, n_bytes, media): the texts' UTF-8 bytes, padded
    with zeros to a positive multiple of ``pad``, as the codes of WAVE files,
    written to a table in the shared folder and read again from there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column("text").cast(pa.large_binary())]
                padded = [t + b"\0" * (pad - len(t) if not t else -len(t) % pad) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([encode(p, tag_of(p)) for p in padded], pa.binary())], ["doc_id", "n_bytes", "media"])

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary"), "telephony", compression="zstd")


def to_pcm(media: DataFrame, rate: int = 16000) -> DataFrame:
    """Media column -> the same rows with ``pcm``: WAVE files of 16-bit PCM at
    another rate. A null stays null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "media"):
                files = {k: read(m.as_buffer().to_pybytes()) for k, m in enumerate(b.column("media")) if m.is_valid}
                out: list[bytes | None] = [None] * b.num_rows
                for (k, file), pieces in zip(files.items(), samples([*files.values()]), strict=True):
                    out[k] = pcm_wave(resample(pieces, file[1], rate), rate)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, pcm binary")


def describe(tag: int, own: int, pieces: Iterable[np.ndarray], rate: int) -> tuple[str, bytes]:
    """Codec, samples, peak, power and zero crossings of decoded audio with the
    checksum of its PCM at another rate, and that PCM as a WAVE file."""
    n = peak = crossings = 0
    power, last, crc = 0, 0, 0

    def watched() -> Iterator[np.ndarray]:
        nonlocal n, peak, crossings, power, last
        for x in pieces:
            wide = x.astype(np.int64)
            n += len(x)
            peak = max(peak, int(np.abs(wide).max()))
            power += int((wide * wide).sum())
            sign = np.concatenate([[last], x]) < 0
            crossings += int((sign[1:] != sign[:-1]).sum())
            last = x[-1]
            yield x

    out = []
    for y in resample(watched(), own, rate):
        out.append(y)
        crc = zlib.crc32(y.astype("<i2").tobytes(), crc)
    return f"{NAMES[tag]};rate={own};samples={n};peak={peak};rms={round((power / max(n, 1)) ** 0.5)};crossings={crossings};pcm{rate}={crc:08x}", pcm_wave(out, rate)


def op1(docs: DataFrame, rate: int = 16000) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, pcm), one row per input row, all
    computed from the bytes read back; pcm is a media column, the audio
    resampled to 16-bit PCM in a WAVE file.

    Null and empty texts are one block of zeros; a text of any length is
    decoded in pieces, and its PCM (4 times the payload, of ADPCM 7.6 times)
    is one value, which Arrow and Spark hold up to 2 GB; repeated rows and null
    ids stay; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "media"):
                rows = []
                stored = [m.as_buffer().to_pybytes() for m in b.column("media")]
                files = [read(media) for media in stored]
                for media, (tag, own, _, codes), pieces in zip(stored, files, samples(files), strict=True):
                    feature, pcm = describe(tag, own, pieces, rate)
                    rows.append((len(codes), hashlib.sha256(codes).hexdigest(), zlib.crc32(codes[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, pcm))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("n_bytes"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"],
                )

    return store(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary")
