"""Golden values and edge cases of the media functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmloom.functions import audio, bits, colour
from filmloom.operators import layout, quality

HEAD = "ARMovie\nT\nC\nA\n19 video format\n160 pixels\n128 pixels\n16 bits per pixel\n12.5 frames per second\n1 sound format\n{rate}\n1 channels\n{bits}\n25 frames per chunk\n1 number of chunks\n5 even chunk size\n4 odd chunk size\n512 catalogue offset\n0 offset to sprite\n0 size of sprite\n{keys}"


def movie(cat, rate="11025 Hz", bits="8 bits", keys="-1 (no keys)\n", size=600):
    h = HEAD.format(rate=rate, bits=bits, keys=keys).encode("latin-1")
    return (h.ljust(512, b"\n") + cat.encode("latin-1")).ljust(size, b"\0")


def test_movie_files(spark):
    cases = {
        "ok": movie("320,8;4\n384,16;2;3\n"), "period": movie("320,8;\n384,16\n", rate="72 \xb5s samples"), "blank": movie("320,8;4\n384,16;2;3\n", bits="", keys="\x01\x02"),
        "digit": movie("320,8;4\n384,x;2\n"), "outside": movie("320,8;4\n384,999;2\n"), "magic": b"ARMovies" + movie("1,1;\n1,1;\n")[7:], "empty": b"", "short": movie("", size=520),
    }
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "path string, content binary")
    h = {r.path: r for r in layout.parse_headers(files).collect()}
    assert {k: r.status for k, r in h.items()} == {"ok": "ok", "period": "ok", "blank": "ok", "digit": "ok", "outside": "ok", "magic": "malformed", "empty": "malformed", "short": "truncated"}
    assert h["period"].head.sound_rate == 13889 and h["ok"].head.sound_rate == 11025 and h["blank"].head.sound_precision == 0 and h["blank"].head.key_offset == -1
    assert h["ok"].head.frames_per_second == 12.5 and h["ok"].head.last_chunk == 1
    c = {(r.path, r.chunk_no): r for r in layout.read_movies(files).collect()}
    assert (c["ok", 0].video_bytes, c["ok", 0].sound_bytes, c["ok", 0].sound_tracks, c["ok", 0].ok) == (8, 4, 1, True)
    assert (c["ok", 1].sound_bytes, c["ok", 1].sound_tracks, c["ok", 1].ok) == (5, 2, True)
    assert (c["period", 0].sound_tracks, c["period", 0].ok, c["period", 1].ok) == (0, True, False)
    assert not c["digit", 1].ok and not c["outside", 1].ok and c["digit", 0].ok
    assert {p for p, _ in c} == {"ok", "period", "blank", "digit", "outside"}


def test_sound(spark):
    code = spark.range(256).select("id", audio.e8_to_s16(F.col("id")).alias("v")).withColumn("again", audio.e8_to_s16(audio.e8_of_s16(F.col("v")))).collect()
    assert all(r.v == r.again for r in code) and max(r.v for r in code) == 31616 and [r.v for r in code[:6]] == [0, 0, 8, -8, 16, -16]
    table = {r.id: r.v for r in code}
    for r in spark.range(-32768, 32768, 137).select("id", audio.e8_of_s16(F.col("id")).alias("c")).collect():
        assert r.c == min((c for c in table if c % 2 == (r.id < 0)), key=lambda c: (abs(table[c] - r.id), c))
    b = spark.createDataFrame([(bytearray(b"\x88\x44\x77\x00"),)], "b binary")
    zero = audio.adpcm_state(F.lit(0), F.lit(0))
    assert b.select(audio.escape_decode(audio.nibbles(F.col("b"), True), zero)["out"].alias("o")).first().o == [0, 0, 7, 16, 35, 75, 75, 75]
    wave = [int(12000 * np.sin(0.1 * k)) for k in range(512)]
    w = spark.createDataFrame([(wave,), ([],)], "x array<bigint>")
    got = w.select("x", audio.ima_decode(audio.ima_encode(F.col("x"), zero)["out"], zero)["out"].alias("y")).collect()
    x, y = np.array(got[0].x[64:], float), np.array(got[0].y[64:], float)
    assert 10 * np.log10((x**2).mean() / ((x - y) ** 2).mean()) > 25 and got[1].y == []


def test_checksum_and_dither(spark):
    def crc(d):
        c = 0
        for v in d:
            c ^= v << 24
            for _ in range(8):
                c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        return c

    data = [b"", b"\0", b"abc", bytes(range(256)), b"\xff" * 37]
    got = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, b binary").select("i", bits.crc32_msb(F.col("b")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: crc(d) for i, d in enumerate(data)}
    assert colour.bayer(4) == [[0, 8, 2, 10], [12, 4, 14, 6], [3, 11, 1, 9], [15, 7, 13, 5]]
    assert sorted(v for row in colour.bayer(8) for v in row) == list(range(64))


@pytest.mark.parametrize("sizes,start,want", [([1100, 1000], 7, (8, 1)), ([850, 850, 1000], 7, (5, 2)), ([1000], 3, (3, 0)), ([5000] * 40, 26, (28, 2))])
def test_rate(spark, sizes, start, want):
    # the n-th attempt's size; attempts differ from the start by their retries
    seq = F.array(*[F.lit(v) for v in sizes])
    size = lambda level: F.get(seq, F.least(F.abs(level - start), F.lit(len(sizes) - 1)).cast("int"))
    r = spark.range(1).select(quality.rate_level(size, F.lit(start), 1000).alias("s")).first().s
    assert (r.level, r.retries) == want


def test_running_xor(spark):
    v = [int(x) for x in np.random.default_rng(1).integers(0, 64, 1000)]
    df = spark.createDataFrame([(k, i, v[i]) for k in (1, 2) for i in range(len(v))], "k int, i bigint, d bigint")
    got = {(r.k, r.i): r.d_run for r in quality.running_xor(df, ["k"], "i", "d", block=64).collect()}
    acc = 0
    for i, x in enumerate(v):
        acc ^= x
        assert got[1, i] == got[2, i] == acc


def test_vectors_and_thresholds(spark):
    from filmloom.operators.motion import vector_code, vector_code_7
    from filmloom.operators.pictures import temporal_vectors

    v = spark.createDataFrame([(i, *x) for i, x in enumerate(temporal_vectors(8))], "ord long, dx long, dy long")
    code, bits_ = vector_code(F.col("ord"), F.col("dx"), F.col("dy"))
    got = v.select("dx", "dy", code.alias("c"), bits_.alias("b")).collect()
    assert len(got) == 288 and len({(r.c, r.b) for r in got}) == 288 and {r.b for r in got} == {5, 6, 7, 10}
    at = {(r.dx, r.dy): (r.c & 3, r.c >> 2) for r in got}
    assert at[-1, -1] == (0, 0) and at[-1, 0] == (0, 3) and at[1, 0] == (0, 4) and at[1, 1] == (0, 7)
    assert at[-2, -2] == (2, 0) and at[3, 3] == (1, 31) and at[-8, -8] == (3, 0) and at[8, 8] == (3, 239)
    code, bits_ = vector_code_7(F.col("ord"), F.lit(0), F.col("r"))
    seven = spark.createDataFrame([(i, 1 if i < 8 else 2 if i < 24 else 4) for i in range(80)], "ord long, r long").select(code.alias("c"), bits_.alias("b")).collect()
    assert len({(r.c, r.b) for r in seven}) == 80 and seven[0].c == 2 and seven[8].c == 1 and seven[79].c == 3 + 4 * 55
    assert len(quality.THRESHOLDS) == 29 and all(a <= b for x, y in zip(quality.THRESHOLDS, quality.THRESHOLDS[1:]) for a, b in zip(x, y))


def test_prefix_codes(spark):
    from filmloom.operators import codes

    own = codes.canonical([1, 3, 3, 2])
    assert own == ["0", "110", "111", "10"]
    codes.check(own)
    for bad in (["0", "01"], ["", "1"], ["10", "10"]):
        with pytest.raises(ValueError):
            codes.check(bad)
    with pytest.raises(ValueError):
        codes.canonical([1, 1, 1])
    d = spark.createDataFrame([([3, 0, 2, 1],), ([],)], "s array<int>").select("s", codes.written(F.col("s"), own).alias("w"))
    assert [(r.w, r.x) for r in d.select("w", codes.read(F.col("w"), own).alias("x")).collect()] == [("100111110", [3, 0, 2, 1]), ("", [])]
    assert spark.range(1).select(codes.read(F.lit("011"), own).alias("x")).first().x is None


def test_reports_and_words(spark):
    from filmloom.plans.reports import report_totals

    lines = ["codec=19 size=16x8", "reference=a sse_y=10 max_error_y=3 sse_u=0 max_error_u=0 sse_v=1 max_error_v=1", "summary payload_bytes=7 words without", "other sse_y=99", "codec=19 size=16x8", "reference=b sse_y=5 max_error_y=9 sse_u=0"]
    r = report_totals(spark.createDataFrame([(1, x) for x in lines], "r int, l string"), "r", "l").first()
    assert (r.frames, r.pixels, r.payload_bytes, r.sse_y, r.max_error_y, r.sse_u, r.sse_v) == (2, 256, 7, 15, 9, 0, 1) and r.psnr_u == float("inf")
    w = spark.createDataFrame([(5, 31, 16), (64, 0, 0), (-1, 0, 0), (0, 32, 0)], "y long, u long, v long")
    got = w.select(colour.word("6Y5UV", F.col("y"), F.col("u"), F.col("v")).alias("w")).collect()
    assert [x.w for x in got] == [5 | 31 << 6 | 16 << 11, None, None, None]
    f = spark.createDataFrame([(5 | 31 << 6 | 16 << 11,)], "w long").select(*[c.alias(n) for n, c in zip("yuv", colour.fields("6Y5UV", F.col("w")))]).first()
    assert (f.y, f.u, f.v) == (5, 31, 16)


def test_picture_search(spark):
    from filmloom.operators.pictures import best_vectors, copy_profiles, temporal_vectors, with_previous

    own = np.random.default_rng(8)
    first = own.integers(0, 64, (8, 8))
    moved = np.roll(first, (1, 2), (0, 1))  # what is at x, y was at x - 2, y - 1
    d = spark.createDataFrame([(0, first.ravel().tolist()), (1, moved.ravel().tolist())], "frame_no long, y array<long>")
    pairs = with_previous(d, ["y"])
    got = {(r.bx, r.brow): (r.dx, r.dy, r.err) for r in best_vectors(pairs, ["y"]).collect()}
    assert got[1, 1] == (-2, -1, 0) and len(temporal_vectors()) == 288
    for r in copy_profiles(pairs, 2, ["y"]).collect():
        a, b = (p[2 * r.brow : 2 * r.brow + 2, 2 * r.bx : 2 * r.bx + 2] for p in (first, moved))
        assert r.total == abs(a - b).sum() and r.over_3 == (abs(a - b) > 3).sum() and r.most == abs(a - b).max()
