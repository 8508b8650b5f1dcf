import random

import edges
from loomfield.llm import mpeg


def frame(i=0, protected=False, bad=False, version=3, layer=3, pad=0):
    head = mpeg.frame_header(version, layer, protected, 9, 0, pad, 0)
    h = mpeg._read(int.from_bytes(head[1:]))
    body = bytes([i % 200]) * (h.length - 4 - 2 * protected)
    if protected:
        c = 0xFFFF
        for byte in head[2:] + body[: h.side]:  # bit by bit, not by table
            for k in range(7, -1, -1):
                top = (c >> 15) ^ (byte >> k & 1)
                c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
        head += (c ^ (0xFFFF if bad else 0)).to_bytes(2)
    return head + body


def test_plain_stream():
    data = b"".join(frame(i, pad=i % 2) for i in range(50))
    r = mpeg._row(1, data)
    assert (r["frames"], r["samples"], r["sample_rate"], r["mode"]) == (50, 50 * 1152, 44100, "cbr")
    assert r["duration"] == 50 * 1152 / 44100
    assert r["seek"][:3] == [0, 417, 835] and r["junk_bytes"] == 0 and not r["truncated"]


def test_damage_is_passed_over():
    good = [frame(i) for i in range(30)]
    data = b"".join(good[:10]) + b"\xff\xfb\x90 noise \xff\xff" + b"".join(good[10:]) + good[0][:100]
    r = mpeg._row(1, data)
    assert (r["frames"], r["resyncs"], r["junk_bytes"], r["truncated"]) == (30, 1, 12, True)


def test_checksums():
    r = mpeg._row(1, b"".join(frame(i, True, bad=i in (3, 5)) for i in range(20)))
    assert (r["crc_checked"], r["crc_bad"]) == (20, 2)


def test_tables_and_tags():
    for doc in range(300):
        data = mpeg.render(doc, "some text " * 200, "src")
        r = mpeg._row(doc, data)
        assert r["info_agrees"] in (None, True) and not r["truncated"]
        if r["info_table"] in ("Xing", "Info"):
            first = mpeg.header(data, r["seek"][0])
            assert r["samples"] == r["frames"] * first.samples - 576 - 100
        assert r["title"] in (None, f"document {doc}")


def test_payload_comes_back():
    for doc in range(60):
        text = f"payload {doc} é " * 90
        data = mpeg.render(doc, text, "s")
        s = mpeg.read(data)
        got = b"".join(data[p + 4 + 2 * h.protected : p + h.length] for p, h in s.frames)
        assert got.rstrip(b"\0").decode() == text.rstrip("\0")


def test_edges(spark):
    out = {r.doc_id: r for r in mpeg.parse(mpeg.media(edges.documents(spark))).collect()}
    assert out[1].frames == 0 and out[1].version is None and out[2].frames == 1
    odd = spark.createDataFrame([(1, None), (2, b""), (3, b"\xff" * 1000), (4, b"ID3\3\0\0\0\0\0\5"), (5, b"TAG" + b"x" * 125)], "doc_id long, audio binary")
    assert [r.frames for r in mpeg.parse(odd).orderBy("doc_id").collect()] == [0] * 5
    assert mpeg.parse(mpeg.media(edges.empty(spark))).count() == 0


def bitwise(bits):
    c = 0xFFFF
    for b in bits:
        c = ((c << 1) & 0xFFFF) ^ (0x8005 if (c >> 15) ^ b else 0)
    return c


#: Subbands of the tables of layer II with 4, 3 and 2 bits of allocation, by the standard's conditions on kbit/s for a channel and Hz.
def subbands(version, rate, per):
    if version != 3:
        return 4, 7, 19
    if per in (56, 64, 80) or (rate == 48000 and per >= 56):
        return 11, 12, 4
    if per >= 96:
        return 11, 12, 7
    return (2, 10, 0) if rate == 32000 else (2, 6, 0)


def test_layer_two_checksums():
    """Against a reader that goes bit by bit."""
    r = random.Random(1)
    seen = set()
    for version in (3, 2, 0):
        for rate in range(3):
            for index in range(1, 15):
                for mode in range(4):
                    head = bytearray(mpeg.frame_header(version, 2, True, index, rate, 0, mode))
                    head[3] |= r.randrange(4) << 4 if mode == 1 else 0
                    h = mpeg._read(int.from_bytes(head[1:]))
                    body = bytes(r.randrange(256) & r.randrange(256) for _ in range(h.length - 6))
                    bits = [b >> k & 1 for b in body for k in range(7, -1, -1)]
                    sizes = subbands(version, h.rate, h.bitrate / h.channels)
                    widths = [n for n, times in zip((4, 3, 2), sizes) for _ in range(times)]
                    bound = 32 if mode != 1 else 4 * (head[3] >> 4 & 3) + 4
                    at = chosen = 0
                    for k, w in enumerate(widths):
                        for _ in range(1 if mode == 3 or k >= bound else 2):
                            some = any(bits[at : at + w])
                            at += w
                            chosen += some * (2 if k >= bound and mode != 3 else 1)
                    n = at + 2 * chosen
                    if n > len(bits):
                        assert mpeg.covered_bits(h, body) == -1
                        continue
                    assert mpeg.covered_bits(h, body) == n
                    want = bitwise([b >> k & 1 for b in head[2:] for k in range(7, -1, -1)] + bits[:n])
                    s = mpeg.read(bytes(head) + want.to_bytes(2) + body)
                    assert (s.checked, s.bad) == (1, 0)
                    assert mpeg.read(bytes(head) + (want ^ 1).to_bytes(2) + body).bad == 1
                    seen.add(sizes)
    assert len(seen) == 5


def test_free_format():
    r = random.Random(2)
    for layer in (1, 2, 3):
        frames = []
        for k in range(40):
            pad = k % 3 == 0
            head = mpeg.frame_header(3, layer, False, 0, 0, int(pad), 0)
            frames.append(head + bytes(r.randrange(255) for _ in range(700 - 4 + pad * (4 if layer == 1 else 1))))
        data = b"".join(frames)
        row = mpeg._row(1, data[:3500] + b"junk" + data[3500:] if False else data)
        assert row["frames"] == 40 and row["seek"] == [sum(map(len, frames[:k])) for k in range(40)] and not row["truncated"]
        broken = b"".join(frames[:20]) + b"\xff\xfbnoise" + b"".join(frames[20:]) + frames[0][:50]
        row = mpeg._row(1, broken)
        assert (row["frames"], row["resyncs"], row["junk_bytes"]) == (40, 1, 7)


def test_seek_tables_are_read_and_held_against_the_frames():
    kinds = {"Xing": 0, "Info": 0, "VBRI": 0}
    for doc in range(600):
        data = mpeg.render(doc, "some text of a longer document " * 800, "src")
        row = mpeg._row(doc, data)
        if row["info_table"] and row["toc"] is not None:
            kinds[row["info_table"]] += 1
            assert row["toc_agrees"] and row["bytes_agree"], doc
            if row["info_table"] == "VBRI":
                assert set(row["toc"][:-1]) <= set(row["seek"]) or row["resyncs"]
    assert all(kinds.values())
    doc = next(d for d in range(600) if mpeg._row(d, mpeg.render(d, "x " * 9000, "s"))["info_table"] == "Xing")
    data = bytearray(mpeg.render(doc, "x " * 9000, "s"))
    at = data.find(b"Xing") + 16
    data[at + 30 : at + 60] = bytes(30)
    row = mpeg._row(doc, bytes(data))
    assert row["toc_agrees"] is False and row["bytes_agree"] and row["info_agrees"]
