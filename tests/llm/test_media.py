import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import progressive_jpeg as m


def round_trip(payload):
    stream = m.encode_all([payload])[0]
    tiles = m.split_stream(stream)
    coefs = m.decode_coefficients(tiles)
    return b"".join(m.payload_of(image, coefs) for _, image in tiles)


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.lists(st.sampled_from([0, 126, 127, 128, 129, 130, 255]), max_size=3000).map(bytes)))
def test_bytes_survive(data):
    payload = m.padded(data)
    assert len(payload) % 576 == 0 and payload.startswith(data) and round_trip(payload) == payload


def test_long_payloads_become_several_images(monkeypatch):
    monkeypatch.setattr(m, "TILE", m.UNIT * 3)
    payload = m.padded(random.Random(1).randbytes(9000))
    assert round_trip(payload) == payload and len(m.split_stream(m.encode_all([payload])[0])) == 6


def test_samples_are_the_inverse_transform():
    rng = np.random.default_rng(2)
    coefs = rng.integers(-60, 60, (40, 64))
    table = rng.integers(1, 5, 64)
    block = np.zeros((40, 64))
    block[:, m.ZIGZAG] = coefs * table
    x = np.arange(8)
    basis = np.cos((2 * x[None] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)[:, None]
    plain = np.clip(np.einsum("nuv,ux,vy->nxy", block.reshape(40, 8, 8), basis, basis) + 128, 0, 255)
    assert np.abs(m.samples(coefs, table).astype(float) - plain).max() <= 0.52
    # the order that the format fixes, written out as far as it tells the rule
    assert m.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and m.ZIGZAG[-3:].tolist() == [55, 62, 63]


def test_reads_what_another_encoder_writes():
    """A grey image with a restart interval of its own and runs of ended blocks, put together by hand."""
    values = np.zeros((4, 64), int)
    values[:, 0] = [80, -40, 0, 120]
    dc = m._table(*m.DC_TABLE)
    ac = m._table(*m.AC_TABLE)
    bits, before = "", 0
    for v in values[:, 0]:
        d = int(v) - before
        before = int(v)
        size = abs(d).bit_length()
        bits += f"{int(dc[0][size]):0{int(dc[1][size])}b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")
    eob_run = f"{int(ac[0][0x20]):0{int(ac[1][0x20])}b}00"  # four blocks end here
    pack = lambda b: bytes(int((b + "1" * (-len(b) % 8))[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")
    frame = bytes([8, 0, 16, 0, 16, 1, 1, 0x11, 0])
    scan = lambda lo, hi: m._segment(0xDA, bytes([1, 1, 0, lo, hi, 0]))
    data = b"\xff\xd8" + m._segment(0xDB, bytes([0, *[2] * 64])) + m._segment(0xC2, frame) + m._huffman(0, m.DC_TABLE) + m._huffman(0x10, m.AC_TABLE) + scan(0, 0) + pack(bits) + scan(1, 63) + pack(eob_run) + b"\xff\xd9"
    (tensor,) = m.tensors(data)
    assert tensor.shape == (16, 16, 3)
    assert [int(tensor[y, x, 0]) for y, x in ((0, 0), (0, 8), (8, 0), (8, 8))] == [148, 118, 128, 158]


def test_chroma_is_upsampled():
    payload = m.padded(b"")
    (tensor,) = m.tensors(m.encode_all([payload])[0])
    assert tensor.shape[0] % 16 == 0 and tensor.dtype == np.uint8


def test_column(spark):
    from pyspark.sql import functions as F

    texts = [(1, "héllo"), (2, None), (3, ""), (3, ""), (4, "x" * 700), (None, "漢字" * 400)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").select("doc_id", "text", F.coalesce(m.utf8(F.col("text")), F.lit(b"")).alias("b"))
    m.bound_batches(spark)
    rows = df.select("text", m.digest_column(F.col("b")).alias("d"), m.tensor_column(m.encode_column(F.col("b"))).alias("t")).collect()
    seen = {}
    for r in rows:
        payload = m.padded((r.text or "").encode())
        assert (r.d.payload_bytes, r.d.payload_sha256, r.d.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert seen.setdefault(payload, (r.d.media_sha256, r.d.feature)) == (r.d.media_sha256, r.d.feature)
        assert sum(x.height * x.width for x in r.t) == int(r.d.feature.split(":")[0]) and len(r.t[0].rgb) == r.t[0].height * r.t[0].width * 3


def test_broken_streams_are_refused():
    stream = m.encode_all([m.padded(b"abc")])[0]
    with pytest.raises(ValueError):
        m.split_stream(b"nothing" + stream)
