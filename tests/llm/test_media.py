import pytest

from tagloom.llm import ogg
from tests.llm.common import ODD, frame


def plain_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for data in (b"", b"\0", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(data) == plain_crc(data)


@pytest.mark.parametrize("size", [0, 1, 64, 254, 255, 256, 1024, 1025, 70_000, 200_000])
@pytest.mark.parametrize("packet", [255, 1024, 66_000])
def test_round_trip(size, packet):
    samples = bytes(i * 7 % 256 for i in range(size))
    for streams in (1, 2, 3):
        media = ogg.write(samples, streams, 8000, packet)
        back, timed, pages = ogg.read(media)
        assert back == samples and pages >= streams
        ends = {s: t for s, _, t, _ in timed}
        assert sum(ends.values()) * 8000 == pytest.approx(size)


def test_damage_is_noticed():
    media = bytearray(ogg.write(b"abc" * 5000))
    for at in (0, 5, 30, len(media) // 2, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.read_packets(bytes(bad))
    with pytest.raises(ogg.OggError):
        ogg.read_packets(bytes(media[:-10]))


def test_odd_rows(spark):
    media = ogg.write_media(frame(spark, ODD))
    packets = ogg.read_media(media.select("doc_id", "media", "n_bytes"))
    assert packets.where("error is not null").count() == 0
    assert packets.select("doc_id").distinct().count() == len({i for i, _ in ODD})
    rows = ogg.digests(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    assert {r.payload_bytes for r in rows if r.n_bytes == 0} == {64}
    assert ogg.digests(frame(spark, [])).count() == 0
    broken = spark.createDataFrame([(1, bytearray(b"nonsense")), (2, None)], "doc_id long, media binary")
    assert [(r.doc_id, r.error is not None) for r in ogg.read_media(broken).collect()] == [(1, True)]
