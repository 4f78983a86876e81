"""Scans, streams, sources and sinks against plain loops on small made-up inputs."""

import os
import random
import struct
import wave

import pytest
from pyspark.sql import functions as F

from filmloom.functions import audio
from filmloom.operators import bitstream, mux
from filmloom.operators.render import blended
from filmloom.operators.scan import adpcm_track, prefix_scan
from filmloom.sources.files import raw_frames, write_files
from filmloom.sources.movie_sink import write_wavs
from filmloom.sources.walks import sized_blocks, tags, wrapped


def serial(codes, variant):
    steps = [audio.ESCAPE_STEPS.get(i, v) for i, v in enumerate(audio.IMA_STEPS)] if variant == "escape" else audio.IMA_STEPS
    p = i = 0
    out = []
    for c in codes:
        s = steps[i]
        d = (c & 7) * s >> 2 if variant == "escape" else (s >> 3) + (s if c & 4 else 0) + (s >> 1 if c & 2 else 0) + (s >> 2 if c & 1 else 0)
        p = max(-32768, min(32767, p - d if c & 8 else p + d))
        i = max(0, min(88, i + audio.IMA_MOVES[c & 7]))
        out.append(p)
    return out


@pytest.mark.parametrize("variant", ["ima", "escape"])
def test_sound_goes_on_over_chunks(spark, variant):
    rng = random.Random(variant)
    # loud stretches saturate both parts of the state
    tracks = {k: [[rng.choice([7, 15, 7, 7] if n % 3 else range(16)) for _ in range(rng.randrange(0, 40))] for n in range(90)] for k in range(3)}
    rows = [(k, 2 * n, chunk) for k, chunks in tracks.items() for n, chunk in enumerate(chunks)]  # order numbers with gaps
    out = adpcm_track(spark.createDataFrame(rows, "k int, n long, codes array<bigint>"), ["k"], "n", "codes", variant).collect()
    for k, chunks in tracks.items():
        got = [s for r in sorted((r for r in out if r["k"] == k), key=lambda r: r["n"]) for s in r["samples"]]
        assert got == serial([c for chunk in chunks for c in chunk], variant)
        assert max(got) == 32767 or min(got) == -32768


@pytest.mark.parametrize(("variant", "high_first"), [("ima", False), ("escape", True), ("ima", True)])
def test_sums_of_many_chunks(spark, variant, high_first):
    from filmloom.operators import sound

    rng = random.Random(variant)
    loud, edge = bytes([0x77, 0x7F, 0x7F, 0x77]), sound.PIECE
    chunks = [bytes(rng.choice(loud if n % 3 else range(256)) for _ in range(rng.randrange(1, 60))) for n in range(300)]
    chunks += [bytes(rng.choice(loud if n % 2 else range(256)) for _ in range(n)) for n in (edge - 1, edge, edge + 1, 2 * edge, 5 * edge + 7, 40_001)]
    rows = [(n, bytearray(c)) for n, c in enumerate(chunks)] + [(-1, bytearray()), (-2, None)]
    got = sound.adpcm_sums(spark.createDataFrame(rows, "k long, b binary").coalesce(2), "b", variant, high_first).collect()
    want = []
    for n, c in enumerate(chunks):
        codes = [x for v in c for x in ((v >> 4, v & 15) if high_first else (v & 15, v >> 4))]
        out, step = serial(codes, variant), 0
        for x in codes:
            step = max(0, min(88, step + audio.IMA_MOVES[x & 7]))
        want.append((n, len(out), sum(out), max(out), out[-1], step))
    assert sorted(map(tuple, got)) == want


def test_sums_take_time_by_length(spark):
    import time

    from filmloom.operators import sound

    # two million codes in one chunk and as many in short ones: a minute at 15 us a code, as measured of a fold in Columns
    rows = [(0, bytearray(random.Random(1).randbytes(1_000_000)))] + [(k, bytearray(random.Random(k).randbytes(500))) for k in range(1, 2001)]
    d = spark.createDataFrame(rows, "k long, b binary").coalesce(1).cache()
    d.count()
    began = time.monotonic()
    assert sound.adpcm_sums(d, "b", "ima", False).agg(F.sum("n")).first()[0] == 4_000_000
    assert time.monotonic() - began < 20


def test_prefix_scan(spark):
    rows = [(k, n, f"{k}{n} ") for k in "ab" for n in (0, 1, 2, 5, 70, 71, 4000)]
    d = spark.createDataFrame(rows, "k string, n long, s string")
    one = F.struct(F.col("s").alias("s"))
    got = prefix_scan(d, ["k"], "n", one, lambda a, b: F.struct(F.concat(a["s"], b["s"]).alias("s")), F.struct(F.lit("").alias("s")), "before", fan=3).collect()
    for r in got:
        assert r["before"]["s"] == "".join(s for k, n, s in rows if k == r["k"] and n < r["n"])
    assert len(got) == len(rows)
    assert prefix_scan(d.where("n < 0"), ["k"], "n", one, lambda a, b: a, F.struct(F.lit("").alias("s")), "before").count() == 0


def test_codes(spark):
    rng = random.Random(5)
    own = bitstream.strings(bitstream.LUMA_CODES)
    streams = {k: [[rng.randrange(64) for _ in range(rng.choice([0, 1, 1, 2, 30]))] for _ in range(40)] for k in range(4)}
    d = spark.createDataFrame([(k, n, s) for k, chunks in streams.items() for n, s in enumerate(chunks)], "k int, n long, s array<bigint>")
    pieces = bitstream.write_codes(d, ["k"], "n", "s", bitstream.LUMA_CODES).collect()
    chunks = []
    for k, c in streams.items():
        payload = b"".join(bytes(r["body"]) for r in sorted((r for r in pieces if r["k"] == k), key=lambda r: r["at"]))
        bits = "".join(own[s] for chunk in c for s in chunk)
        bits += "0" * (-len(bits) % 8)
        assert payload == bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        chunks += [(k, n, payload[i : i + 5]) for n, i in enumerate(range(0, len(payload), 5))]
    back = bitstream.read_codes(spark.createDataFrame(chunks, "k int, n long, b binary"), ["k"], "n", "b", bitstream.LUMA_CODES).collect()
    for k, c in streams.items():
        want = [s for chunk in c for s in chunk]
        got = [s for r in sorted((r for r in back if r["k"] == k), key=lambda r: r["n"]) for s in r["symbols"]]
        assert got[: len(want)] == want
    with pytest.raises(Exception, match="without a code"):
        bitstream.write_codes(spark.createDataFrame([(1, 0, [64])], "k int, n long, s array<bigint>"), ["k"], "n", "s", bitstream.LUMA_CODES).collect()
    with pytest.raises(ValueError, match="prefix code"):
        bitstream.strings([(0, 1), (0, 2), (3, 2)])


def test_codes_of_bytes_end_with_the_stream(spark):
    rng = random.Random(6)
    own = bitstream.strings(bitstream.LUMA_CODES)
    # chunks of very different sizes, empty ones and symbols of the longest codes
    streams = {k: [bytes(rng.randrange(64) if k else rng.randrange(25, 41) for _ in range(rng.choice([0, 1, 2, 700]))) for _ in range(12)] for k in range(6)}
    d = spark.createDataFrame([(k, n, bytearray(s)) for k, chunks in streams.items() for n, s in enumerate(chunks)], "k int, n long, s binary").repartition(3)
    pieces, chunks, bits = bitstream.write_codes(d, ["k"], "n", "s", bitstream.LUMA_CODES).collect(), [], {}
    for k, c in streams.items():
        payload = b"".join(bytes(r["body"]) for r in sorted((r for r in pieces if r["k"] == k), key=lambda r: r["at"]))
        bits[k] = sum(len(own[s]) for chunk in c for s in chunk)
        assert len(payload) == -(-bits[k] // 8)
        cuts = [0, *sorted(rng.sample(range(2, len(payload) - 2, 2), 9)), len(payload)]
        chunks += [(k, n, payload[a:b], payload[b : b + 2], min(8 * (b - a), bits[k] - 8 * a)) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    c = spark.createDataFrame(chunks, "k int, n long, b binary, ahead binary, used long").repartition(3)
    back = bitstream.read_codes(c, ["k"], "n", "b", bitstream.LUMA_CODES, "ahead", "used").collect()
    told = bitstream.read_codes(c, ["k"], "n", "b", bitstream.LUMA_CODES, "ahead", "used", (["size"], lambda symbols, counts: [counts])).collect()
    for k, chunk in streams.items():
        rows = sorted((r for r in back if r["k"] == k), key=lambda r: r["n"])
        assert [s for r in rows for s in r["symbols"]] == [s for x in chunk for s in x]
        assert [len(r["symbols"]) for r in rows] == [r["size"] for r in sorted((r for r in told if r["k"] == k), key=lambda r: r["n"])]
    # what the end leaves of a code is no symbol, though a code begins behind its first digit
    whole = "".join(own[s] for s in (0, 0, 40))
    left = whole[:8]
    body = bytes(int(left[i : i + 8][::-1], 2) for i in range(0, len(left), 8))
    rest = bitstream.read_codes(spark.createDataFrame([(1, 0, bytearray(body))], "k int, n long, b binary"), ["k"], "n", "b", bitstream.LUMA_CODES).first()
    assert rest["symbols"] == [0, 0] and left.endswith("0011")


def test_sync_points(spark):
    rng = random.Random(9)
    frames = {m: [rng.choice([10, 300, 2000, 900, 70_000 if m == 1 else 50]) for _ in range(200)] for m in range(3)}
    d = spark.createDataFrame([(m, i, n, 1000 * i) for m, sizes in frames.items() for i, n in enumerate(sizes)], "m int, i long, n long, t long")
    got = {(r["m"], r["i"]): (r["back"], r["sync_bytes"]) for r in mux.sync_points(d, "m", "i", "n", "t", distance=4096).collect()}
    width = lambda v: max(1, -(-v.bit_length() // 7))
    want = {}
    for m, sizes in frames.items():
        pos, last = 0, None
        for i, n in enumerate(sizes):
            if last is None or pos - last >= 4096:
                back = 0 if last is None else (pos - last) // 16
                body = width(1000 * i) + width(back)
                want[m, i] = (back, 8 + width(body + 4) + body + 4)
                last = pos
                pos += want[m, i][1]
            pos += n
    assert got == want


def test_walks():
    chunk = lambda t, body, more=0: t + struct.pack("<I", 8 + len(body) + more) + body
    data = chunk(b"AAAA", b"xyz") + chunk(b"BBBB", b"") + chunk(b"CCCC", b"q", 1)
    assert list(tags(data)) == [("AAAA", 0, 11, True), ("BBBB", 11, 8, True), ("CCCC", 19, 10, False)]
    assert list(tags(b"")) == list(tags(b"short")) == []
    assert list(tags(chunk(b"AAAA", b"") + b"ZZZZ\0\0\0\0" + b"12345678")) == [("AAAA", 0, 8, True), ("ZZZZ", 8, 0, False)]
    block = lambda body: struct.pack("<I", len(body) + 8) + body + struct.pack("<I", len(body) + 8)
    assert list(sized_blocks(block(b"one") + block(b"") + struct.pack("<I", 0) + block(b"no"))) == [(4, b"one"), (15, b"")]
    assert list(sized_blocks(block(b"one")[:-1])) == []
    frame = lambda body, extra: struct.pack("<I", len(body) + extra) + bytes(12) + body
    for kind, extra in (("moviefs", 12), ("videofs", 28)):
        good = frame(b"first", extra) + bytes(16) + frame(b"second", extra)
        assert [b for _, b in wrapped(kind)(good)] == [b"first", b"second"]
        assert [b for _, b in wrapped(kind)(good + frame(b"", extra) + frame(b"third", extra))] == [b"first", b"second"]
        assert [b for _, b in wrapped(kind)(good[:-1])] == [b"first"]
        assert list(wrapped(kind)(bytes(64))) == []


def test_files_by_ranges(spark, tmp_path):
    for n, size in (("a", 12 * 40), ("b", 12 * 7 + 5), ("empty", 0), ("tiny", 3)):
        (tmp_path / n).write_bytes(bytes(i % 251 for i in range(size)))
    got = raw_frames(spark, str(tmp_path), 2, 2, partition_bytes=60)
    assert got.rdd.getNumPartitions() > 8
    rows = sorted(map(tuple, got.collect()))
    want = [(n, k, bytes(i % 251 for i in range(12 * k, 12 * k + 12)), "ok") for n, m in (("a", 40), ("b", 7)) for k in range(m)] + [("b", 7, None, "partial"), ("tiny", 0, None, "partial")]
    assert rows == sorted(want)
    with pytest.raises(Exception, match="must have bytes"):
        raw_frames(spark, str(tmp_path), 0, 2).count()


def test_many_short_files_share_tasks(spark, tmp_path):
    sizes = {f"{n:04d}": 12 * (n % 4) + 5 * (n % 3 == 1) for n in range(3000)}
    for n, size in sizes.items():
        (tmp_path / n).write_bytes(bytes((int(n) + i) % 251 for i in range(size)))
    (tmp_path / "long").write_bytes(bytes(i % 251 for i in range(12 * 5000)))
    got = raw_frames(spark, str(tmp_path), 2, 2, partition_bytes=24)
    assert 256 < got.rdd.getNumPartitions() < 3100
    want = [(n, k, bytes((int(n) + i) % 251 for i in range(12 * k, 12 * k + 12)), "ok") for n, size in sizes.items() for k in range(size // 12)]
    want += [(n, size // 12, None, "partial") for n, size in sizes.items() if size % 12]
    want += [("long", k, bytes(i % 251 for i in range(12 * k, 12 * k + 12)), "ok") for k in range(5000)]
    assert sorted(map(tuple, got.coalesce(8).collect()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_sink(spark, tmp_path):
    rows = [(f"file {k}", n, None if n == 3 else f"{k}:{n};".encode()) for k in range(5) for n in range(20)]
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame(rows, "f string, n int, b binary").repartition(7)
    write_files(d, str(tmp_path), F.col("f"), [F.col("n")], F.col("b"))
    assert sorted(os.listdir(tmp_path)) == [f"file {k}" for k in range(5)]
    assert (tmp_path / "file 2").read_bytes() == b"".join(f"2:{n};".encode() for n in range(20) if n != 3)
    with pytest.raises(Exception, match="written twice"):
        write_files(d, str(tmp_path), F.col("f"), [F.col("n")], F.col("b"))
    write_files(d.where("n < 2"), str(tmp_path), F.col("f"), [F.col("n")], F.col("b"), overwrite=True)
    assert (tmp_path / "file 2").read_bytes() == b"2:0;2:1;"
    # a task that fails leaves nothing behind, not even of the tasks that did not
    out = tmp_path / "new"
    bad = F.when((F.col("f") == "file 4") & (F.col("n") == 19), F.raise_error(F.lit("broken"))).otherwise(F.col("b"))
    with pytest.raises(Exception, match="broken"):
        write_files(d, str(out), F.col("f"), [F.col("n")], bad)
    assert [x for x in os.listdir(out) if not x.startswith("_")] == [] if out.exists() else True


def test_sound_files(spark, tmp_path):
    samples = [(t, n, struct.pack("<4h", *range(n * 4 + t, n * 4 + t + 4))) for t in (1, 2) for n in range(9)]
    write_wavs(spark.createDataFrame(samples, "track long, order long, body binary"), str(tmp_path), 8000, 2)
    with wave.open(str(tmp_path / "2.wav")) as w:
        assert (w.getnchannels(), w.getframerate(), w.getsampwidth(), w.getnframes()) == (2, 8000, 2, 18)
        assert w.readframes(18) == struct.pack("<36h", *range(2, 38))


def test_tiles_do_not_show(spark):
    rng = random.Random(2)
    blocks = [(1, x, y, rng.randrange(256), rng.randrange(128), rng.randrange(256), rng.random() < 0.3, rng.randrange(4), rng.randrange(256)) for x in range(7) for y in range(5)]
    d = spark.createDataFrame(blocks, "k int, bx long, by long, green long, blue long, red long, textured boolean, step long, signs long")

    def picture(tile):
        out = {}
        for r in blended(d, "k", 14, 10, tile).collect():
            out |= {(r["x"] + i, r["y"]): v for i, v in enumerate(r["pixels"])}
        return out

    whole = picture(16)
    assert len(whole) == 140
    assert picture(1) == picture(2) == picture(3) == whole


@pytest.mark.parametrize(("number", "status"), [("320", "ok"), ("4294967295", "ok"), ("4294967296", "malformed"), ("99999999999999999999", "malformed"), ("x", "malformed")])
def test_numbers_of_headers_have_32_bits(spark, number, status):
    from filmloom.operators.layout import parse_headers

    lines = ["ARMovie", "t", "c", "a", "19", number, "8", "16", "25", "1", "8000", "1", "8", "25", "0", "0", "0", "300", "0", "0", "-1 (no keys)"]
    content = ("\n".join(lines) + "\n").encode().ljust(400, b"\0")
    got = parse_headers(spark.createDataFrame([(content,)], "content binary")).first()
    assert got["status"] == status
