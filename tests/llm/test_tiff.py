import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeward.llm import tiff


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(7)
    pages = [rng.integers(0, 4, (h, w, s)).astype(np.uint8) for h, w, s in ((37, 29, 1), (5, 64, 3), (90, 70, 3))]
    media = tiff.write_tiff(pages, compression, predictor, tile, order, strip_rows=16)
    back = list(tiff.read_pages(media))
    assert [p.number for p in back] == [0, 1, 2]
    assert all((p.pixels == q).all() for p, q in zip(back, pages, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 4))
def test_codecs_are_lossless(data, times):
    data = data * times
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_full_table():
    data = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_planes_and_narrow_samples():
    rng = np.random.default_rng(2)
    page = rng.integers(0, 256, (35, 50, 3)).astype(np.uint8)
    for tile in (0, 16):
        for compression in tiff.ENCODERS:
            assert (next(tiff.read_pages(tiff.write_tiff([page], compression, 2, tile, ">", 8, planar=True))).pixels == page).all()


def hand_made(order, fields, data, big=False):
    """A TIFF of one strip, spelled out."""
    import struct

    entry, count, at = ("HHQ8s", "Q", 16) if big else ("HHI4s", "H", 8)
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, at + len(data)) if big else struct.pack(order + "HI", 42, at + len(data)))
    fields = {273: at, 279: len(data)} | fields
    body = struct.pack(order + count, len(fields))
    for tag in sorted(fields):
        value = struct.pack(order + "I", fields[tag]).ljust(8 if big else 4, b"\0")
        body += struct.pack(order + entry, tag, 4, 1, value)
    return head + data + body + bytes(8 if big else 4)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_bytes_written_elsewhere(order, big):
    read = lambda fields, data: next(tiff.read_pages(hand_made(order, fields, data, big))).pixels
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")  # the example of the PackBits note
    unpacked = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert read({256: 24, 257: 1, 258: 8, 259: 32773}, packed).tobytes() == unpacked
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]  # the example of the format's LZW section, nine bits each
    bits = "".join(f"{c:09b}" for c in codes).ljust(88, "0")
    assert read({256: 9, 257: 1, 258: 8, 259: 5}, int(bits, 2).to_bytes(11, "big")).ravel().tolist() == [7, 7, 7, 8, 8, 7, 7, 6, 6]
    assert read({256: 10, 257: 2, 258: 1}, bytes([0b10110011, 0b01000000, 0b00001111, 0b11000000]))[:, :, 0].tolist() == [[1, 0, 1, 1, 0, 0, 1, 1, 0, 1], [0, 0, 0, 0, 1, 1, 1, 1, 1, 1]]
    assert read({256: 3, 257: 1, 258: 4}, bytes([0x1F, 0xA0])).ravel().tolist() == [1, 15, 10]
    assert read({256: 2, 257: 1, 258: 32}, np.array([7, 1 << 31], order + "u4").tobytes()).ravel().tolist() == [7, 1 << 31]
    floats = np.array([1.5, -2.25, 3e30], np.float32)
    assert read({256: 3, 257: 1, 258: 32, 339: 3}, floats.astype(order + "f4").tobytes()).ravel().tolist() == floats.tolist()
    planes = floats.astype(">f4").view(np.uint8).reshape(3, 4).T.ravel()
    assert read({256: 3, 257: 1, 258: 32, 339: 3, 317: 3}, np.diff(planes, prepend=np.uint8(0)).astype(np.uint8).tobytes()).ravel().tolist() == floats.tolist()


def test_faults_are_errors_and_never_crash(spark):
    import struct

    no_values = hand_made("<", {256: 2, 257: 2, 258: 8}, bytes(4)).replace(struct.pack("<HHI", 256, 4, 1), struct.pack("<HHI", 256, 4, 0))
    bad = [no_values, *(hand_made("<", f, bytes(4)) for f in ({256: 2, 257: 2, 258: 8, 277: 0, 284: 2}, {256: 1 << 31, 257: 1 << 31, 258: 8}, {256: 0, 257: 2, 258: 8}, {256: 2, 257: 2, 258: 8, 259: 8}, {256: 2, 257: 2, 258: 9}, {256: 2, 257: 2, 258: 8, 317: 7}, {256: 2, 257: 2, 258: 8, 278: 0}))]
    for media in bad:
        with pytest.raises(tiff.TiffError):
            list(tiff.read_pages(media))
    df = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(bad)], "doc_id long, media binary")
    assert {r.id for r in tiff.tiff_pages(df, "doc_id", "media").where("error is not null").collect()} == set(range(len(bad)))
    whole = tiff.write_tiff([np.arange(60, dtype=np.uint8).reshape(4, 5, 3)], tiff.LZW)
    rng = np.random.default_rng(9)
    for _ in range(400):  # damaged anywhere
        media = bytearray(whole)
        for at in rng.integers(0, len(media), 3):
            media[at] = rng.integers(0, 256)
        try:
            list(tiff.read_pages(bytes(media[: rng.integers(1, len(media) + 1)])))
        except tiff.TiffError:
            pass


@pytest.mark.parametrize("layout", range(len(tiff.LAYOUTS)))
def test_payloads_of_every_layout(layout, monkeypatch):
    monkeypatch.setattr(tiff, "LAYOUTS", (tiff.LAYOUTS[layout],))
    payload = tiff.pad(("text of any kind, again and again; " * 900 + "\u00e9" * 7000).encode())
    assert b"".join(p.pixels.tobytes() for p in tiff.read_pages(tiff.store_payload(payload))) == payload


@pytest.mark.parametrize("media", [b"", b"II", b"not a tiff at all", tiff.store_payload(b" " * 192)[:40]])
def test_broken_media(media):
    with pytest.raises(tiff.TiffError):
        list(tiff.read_pages(media))


def test_pages_table(spark):
    two = tiff.write_tiff([np.zeros((3, 4, 1), np.uint8), np.ones((2, 2, 3), np.uint8)])
    df = spark.createDataFrame([(1, bytearray(two), "x"), (2, None, "x"), (3, bytearray(b"junk"), "x")], "doc_id long, media binary, page string")
    rows = {(r.id, r.page): r for r in tiff.tiff_pages(df, "doc_id", "media").collect()}
    assert set(rows) == {(1, 0), (1, 1), (3, None)}
    assert bytes(rows[1, 1].pixels) == b"\x01" * 12 and rows[3, None].error


def test_stored_digests(spark):
    texts = [(1, None), (2, ""), (3, "é" * 500_000), (4, "abc"), (4, "abc"), (None, "abc")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_bytes", "'x' as feature")
    rows = tiff.stored_digests(df).collect()
    assert len(rows) == 6
    by = {r.doc_id: r for r in rows}
    assert by[1].payload_bytes == by[2].payload_bytes == 192 and by[1].media_sha256 == by[2].media_sha256
    assert by[3].n_bytes == 1_000_000 and by[3].payload_bytes % 192 == 0 and by[3].n_pages == 2
    assert by[4].payload_sha256 == by[None].payload_sha256
    assert tiff.stored_digests(df.limit(0)).count() == 0


def test_feature_covers_all_pages(spark):
    page, half = "a" * (tiff.PAGE_ROWS * tiff.ROW_BYTES), tiff.PAGE_ROWS * tiff.ROW_BYTES // 2
    texts = [(1, page + "~" * half + "!" * half), (2, page + "!" * half + "~" * half), (3, page + "~" * half + "!" * half)]
    by = {r.doc_id: r for r in tiff.stored_digests(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    hashes = {k: r.feature.split(":")[2] for k, r in by.items()}
    assert by[1].n_pages == 2 and hashes[1] != hashes[2] and hashes[1] == hashes[3]


def test_hash_of_pages_is_that_of_their_joined_rows():
    rng = np.random.default_rng(3)
    pages = [tiff.Page(i, 64, h, 3, rng.integers(0, 256, (h, 64, 3)).astype(np.uint8)) for i, h in enumerate((40, 1, 23))]
    assert tiff.average_hash(*pages) == tiff.average_hash(tiff.Page(0, 64, 64, 3, np.concatenate([p.pixels for p in pages])))
