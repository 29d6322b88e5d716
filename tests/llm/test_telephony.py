import hashlib
import random
import zlib

import numpy as np
import pytest

from factloom.llm import telephony as tp

SCHEMA = "doc_id long, text string, lang string, n_bytes string, media string, feature long"


def test_law_tables_against_the_definition():
    for code in range(256):
        u = ~code & 0xFF
        t = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
        assert tp.LAW[tp.MULAW][code] == (-t if u & 128 else t)
        a = code ^ 0x55
        s, m = a >> 4 & 7, a & 15
        v = (m << 4) + 8 if s == 0 else (m << 4) + 264 << s - 1
        assert tp.LAW[tp.ALAW][code] == (v if a & 128 else -v)


def slow_adpcm(block):
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(tp.STEPS[index])
            d = step >> 3
            d += (step >> 2) * (n & 1) + (step >> 1) * (n >> 1 & 1) + step * (n >> 2 & 1)
            sample = max(-32768, min(32767, sample - d if n & 8 else sample + d))
            index = max(0, min(88, index + (2 * (n & 7) - 6 if n & 4 else -1)))
            out.append(sample)
    return out


def test_adpcm_blocks_against_a_loop():
    rng = random.Random(1)
    blocks = np.array([[rng.randrange(256) for _ in range(64)] for _ in range(40)], np.uint8)
    assert tp.decode_adpcm(blocks).tolist() == [slow_adpcm(bytes(b)) for b in blocks]


@pytest.mark.parametrize("tag", [tp.MULAW, tp.ALAW, tp.ADPCM])
def test_files_give_their_codes_back(tag):
    payload = bytes(range(256)) * 3
    got = tp.read(tp.encode(payload, tag))
    assert got[0] == tag and bytes(got[3]) == payload
    with pytest.raises(ValueError):
        tp.read(tp.encode(payload, tag)[:-9])


@pytest.mark.parametrize(("rate", "to"), [(8000, 16000), (8000, 11025), (16000, 8000), (8000, 8000)])
def test_resampling_has_no_seams_and_keeps_a_tone(rate, to):
    n = np.arange(4000)
    tone = (9000 * np.sin(2 * np.pi * 440 * n / rate)).astype(np.int16)
    whole = np.concatenate(list(tp.resample([tone], rate, to)))
    parts = np.concatenate(list(tp.resample([tone[a : a + 257] for a in range(0, 4000, 257)], rate, to)))
    assert np.array_equal(whole, parts) and len(whole) == -(-4000 * to // rate)
    want = 9000 * np.sin(2 * np.pi * 440 * np.arange(len(whole)) / to)
    assert np.abs(whole - want)[200:-200].max() < 200
    assert list(tp.resample([], rate, to)) == []


def test_query_round_trip(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "long " * 120_000, "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t, None, "n", "m", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r for r in tp.op1(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        b = (t or "").encode()
        padded = b + bytes(64 if not b else -len(b) % 64)
        r = rows[i if i else None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = tp.encode(padded, tp.tag_of(padded))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        if len(padded) < 1000:  # the stored PCM is the decoded audio at twice the rate
            blocks = [slow_adpcm(padded[k : k + 64]) for k in range(0, len(padded), 64)] if tp.tag_of(padded) == tp.ADPCM else [[int(tp.LAW[tp.tag_of(padded)][c]) for c in padded]]
            audio = np.array([x for b in blocks for x in b], float)
            want = np.zeros(2 * len(audio))
            taps = tp._filters(2, 1)
            held = np.concatenate([np.zeros(tp.TAPS - 1), audio, np.zeros(tp.TAPS + 1)])
            for n in range(len(want)):
                want[n] = held[n // 2 : n // 2 + 2 * tp.TAPS] @ taps[n % 2]
            got = np.frombuffer(r.pcm[44:], "<i2")
            assert r.pcm[:4] == b"RIFF" and len(got) == len(want) and np.abs(got - np.clip(want, -32768, 32767)).max() <= 1
        assert f"pcm16000={zlib.crc32(r.pcm[44:]):08x}" in r.feature
    assert rows[7][1:] == rows[8][1:]
    assert {r.doc_id: r.pcm for r in tp.to_pcm(tp.store(docs)).collect()} == {i: r.pcm for i, r in rows.items()}
    assert tp.op1(docs.limit(0)).count() == 0
