import os
import struct
import zlib

import pytest

from spanloom.llm import matroska as M


def element(code, body):
    return M._element(code, body)


@pytest.mark.parametrize("n", [64, 512, 576, 4096, 4160, 65_536, 65_600, 300_032])
def test_round_trip(n):
    x = os.urandom(n)
    data = M.mux(x)
    packets, cues, error = M.parse(data)
    assert error is None and b"".join(data[p.start : p.start + p.size] for p in packets) == x
    assert [p.timestamp for p in packets] == sorted(p.timestamp for p in packets) and len(cues) == packets[-1].cluster + 1


def test_cues_point_at_clusters():
    data = M.mux(os.urandom(200_000))
    _, cues, _ = M.parse(data)
    segment = data.index(M.SEGMENT.to_bytes(4, "big"))
    _, _, body = M._number(data, segment, True)
    _, _, start = M._number(data, body)
    assert all(data[start + at : start + at + 4] == M.CLUSTER.to_bytes(4, "big") for _, _, at in cues)


def block(flags, lace, frames, code=M.SIMPLE_BLOCK):
    return element(code, b"\x82" + struct.pack(">hB", 7, flags) + lace + b"".join(frames))


def test_xiph_lacing_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 255, b"c" * 5]
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\xff" + M._uint(M.CLUSTER_TIME, 100) + block(0x02, bytes([2, 255, 45, 255, 0]), frames)
    data = M._HEAD + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster
    packets, _, error = M.parse(data)
    assert error is None and [data[p.start : p.start + p.size] for p in packets] == frames
    assert {(p.track, p.timestamp, p.keyframe, p.lacing) for p in packets} == {(2, 107, False, "xiph")}


def test_block_groups_and_references():
    group = lambda *more: element(M.BLOCK_GROUP, block(0, b"", [b"x"], M.BLOCK) + b"".join(more))
    data = M._HEAD + element(M.SEGMENT, element(M.CLUSTER, M._uint(M.CLUSTER_TIME, 0) + group(element(M.REFERENCE, b"\xff")) + group()))
    assert [p.keyframe for p in M.parse(data)[0]] == [False, True]


def test_ebml_lacing_with_falling_sizes():
    sizes = [500, 20, 9000, 1]
    frames = [os.urandom(n) for n in sizes]
    data = M._HEAD + element(M.SEGMENT, element(M.CLUSTER, M._block(0, frames)))
    packets, _, error = M.parse(data)
    assert error is None and [data[p.start : p.start + p.size] for p in packets] == frames


@pytest.mark.parametrize("cut", [0, 1, 30, 100, 200, 400])
def test_files_that_end_early(cut):
    data = M.mux(os.urandom(640))
    packets, _, error = M.parse(data[:cut])
    assert packets == [] and (error is not None or cut <= 40)


def test_every_cut_is_told():
    data = M.mux(os.urandom(70_000))
    for cut in [*range(400), *range(400, len(data), 97)]:
        assert M.parse(data[:cut])[2] is not None


def test_elements_end_with_their_parents():
    inner = element(M.SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", 0, 0) + b"x" * 50)
    cluster = element(M.CLUSTER, M._uint(M.CLUSTER_TIME, 0) + inner[:-20])
    assert "behind its parent" in M.parse(M._HEAD + element(M.SEGMENT, cluster + M._uint(M.CUE_TIME, 1) * 10))[2]


def test_times_of_laced_frames():
    packets = M.parse(M.mux(os.urandom(64 * 1000)))[0]
    assert [p.timestamp for p in packets] == [i * 64 for i in range(125)]


def test_time_scale():
    info = element(M.INFO, M._uint(M.TIME_SCALE, 500_000))
    group = element(M.CLUSTER, M._uint(M.CLUSTER_TIME, 10) + block(0, b"", [b"x"]))
    assert M.parse(M._HEAD + element(M.SEGMENT, info + group))[0][0].timestamp == 8  # 17 times half a millisecond


def test_noise():
    for i in range(200):
        M.parse(os.urandom(i))
    assert M.parse(None) == ([], [], "null")


def test_packet_table(spark):
    df = spark.createDataFrame([(1, M.mux(b"a" * 640)), (2, None), (3, b"\x00")], "id long, media binary")
    rows = M.packet_table(df, "id", "media").collect()
    assert [(r.id, r.packet, r.size) for r in rows if r.id == 1] == [(1, 0, 512), (1, 1, 128)]
    assert {r.id: r.error is not None for r in rows} == {1: False, 2: True, 3: True}


def test_digests(spark, odd):
    from oddrows import ODD

    import hashlib

    texts = {r[0]: (r[1] or "").encode() for r in ODD}
    for r in M.op7_matroska(spark, odd).collect():
        raw = texts[r.doc_id]
        payload = M.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(M.mux(payload)), hashlib.sha256(M.mux(payload)).hexdigest()) and r.payload_bytes % 64 == 0 < r.payload_bytes
