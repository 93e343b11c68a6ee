import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionframe.operators import packed
from motionframe.params import PROFILES, DetectParams
from motionframe.plans import detect as D
from motionframe.sources import frames as S
from motionframe.sources import sinks, video
from motionframe.streaming import detect as T
from tests.helpers import packed_frames, pixel_table

RNG = np.random.default_rng(5)
STILL = RNG.integers(40, 60, (20, 24))


def moved(*places):
    a = STILL.copy()
    for y, x in places:
        a[y : y + 4, x : x + 5] = 220
    return a


FRAMES = [STILL, moved((8, 8)), moved((2, 3), (12, 15)), STILL]
SMALL = DetectParams(ksize=5, morph_ksize=5)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("frame_id", "label", "x", "y", "width", "height", "area").collect())


@pytest.mark.parametrize("p", [SMALL, SMALL.but(sigma=2.0, threshold=10), SMALL.but(morphology="dilate"), SMALL.but(morphology="erode_dilate", strict=True), SMALL.but(morphology="open_neutral", border="reflect101", sigma=2.0)])
def test_plans_agree(spark, p):
    pack = rows_of(D.detect(packed_frames(spark, *FRAMES), p))
    assert pack and pack == rows_of(D.detect(packed_frames(spark, *FRAMES), p, "relational"))
    assert pack == rows_of(D.detect(pixel_table(spark, *FRAMES), p, "packed", 20, 24))


def test_objects_are_found(spark):
    got = rows_of(D.detect(packed_frames(spark, *FRAMES), SMALL))
    assert [(f, x, y, w, h) for f, _, x, y, w, h, _ in got] == [(1, 8, 8, 5, 4), (2, 3, 2, 5, 4), (2, 15, 12, 5, 4)]


def test_colour_frames(spark):
    colour = [np.repeat(f[..., None], 3, axis=2) for f in FRAMES]
    for name in ("cpu", "gpu", "opencv"):
        p = PROFILES[name].but(ksize=5, morph_ksize=3 if name == "opencv" else 5)
        assert D.detect(S.from_arrays(spark, colour), p).where("frame_id IN (1, 2)").count() == 3


def test_no_frames_and_one_frame(spark):
    empty = packed_frames(spark, STILL).where("false")
    with pytest.raises(ValueError, match="first frame"):
        D.detect(empty, SMALL)
    assert D.detect(packed_frames(spark, STILL), SMALL).count() == 0


def test_frames_of_unlike_size(spark):
    with pytest.raises(Exception, match="against a background"):
        D.detect(packed_frames(spark, STILL, np.zeros((4, 4))), SMALL).collect()
    with pytest.raises(ValueError, match="unlike size"):
        S.frame_size(packed_frames(spark, STILL, np.zeros((4, 4))))


def test_frames_without_data_and_repeated_ones(spark):
    frames = packed_frames(spark, *FRAMES)
    with pytest.raises(Exception, match="without size or data"):
        packed.detect(frames.withColumn("data", F.lit(None).cast("binary")), STILL.astype(np.uint8), SMALL).collect()
    twice = frames.union(frames)
    assert rows_of(D.detect(twice, SMALL)) == sorted(2 * rows_of(D.detect(frames, SMALL)))


def test_pack_and_unpack(spark):
    frames = packed_frames(spark, *FRAMES)
    again = S.pack(S.unpack(frames), 20, 24)
    assert {r.frame_id: bytes(r.data) for r in again.collect()} == {r.frame_id: bytes(r.data) for r in frames.collect()}
    meta = S.metadata(frames, 50.0).head()
    assert (meta.frame_count, meta.height, meta.width, meta.duration_ms) == (4, 20, 24, 80.0)
    assert S.from_arrays(spark, [np.array([[256, 257]])]).head().data == bytes([0, 1])
    assert S.blank(spark, 2, 3).head().data == bytes(6)


def test_stage_summary(spark):
    got = {r.stage: r for r in D.stage_summary(pixel_table(spark, *FRAMES), SMALL, 20, 24).collect()}
    assert got["threshold"].n_pixels == 60 and got["morphology"].n_pixels == 60 and got["grayscale"].n_frames == 4


def test_stage_report(spark):
    got = {r.stage: r for r in D.stage_report(packed_frames(spark, *FRAMES), SMALL).collect()}
    assert set(got) == set(packed.STAGES) and all(r.frames == 3 and r.total_ms >= 0 for r in got.values())
    assert abs(sum(r.percent for r in got.values()) - 100) < 1e-6


def test_prototype_keeps_the_largest(spark):
    big = moved((2, 3), (12, 15))
    big[2:9, 3:9] = 220
    got = D.detect_prototype(pixel_table(spark, STILL, big), 20, 24).collect()
    assert len(got) == 1 and (got[0].kind, got[0].x, got[0].width) == ("outer", 3, 6)


def test_prototype_counts_holes_and_nested_objects(spark):
    ring = STILL.copy()
    ring[2:16, 2:20] = 220
    ring[5:13, 5:17] = STILL[5:13, 5:17]
    ring[7:11, 8:14] = 220
    got = D.detect_prototype(pixel_table(spark, STILL, ring), 20, 24, k=2).collect()
    assert sorted((r.kind, r.width > 10) for r in got) == [("hole", True), ("outer", True)]


def test_images_are_read_and_written(spark, tmp_path):
    colour = S.from_arrays(spark, [np.repeat(f[..., None], 3, axis=2) * np.array([1, 1, 0]) + np.array([0, 0, 7]) for f in FRAMES])
    assert sinks.write_pngs(colour, str(tmp_path / "png")) == 4
    again = S.read_images(spark, str(tmp_path / "png"))
    assert sorted((r.frame_id, bytes(r.data)) for r in again.collect()) == sorted((r.frame_id, bytes(r.data)) for r in colour.collect())


def test_images_are_numbered_by_name(spark, tmp_path):
    frames = S.from_arrays(spark, [np.full((2, 3), i) for i in range(37)])
    sinks.write_pngs(frames.withColumn("frame_id", 5 + 3 * frames.frame_id).repartition(7), str(tmp_path / "png"))
    again = S.read_images(spark, str(tmp_path / "png"))
    assert sorted((r.frame_id, bytes(r.data)) for r in again.collect()) == [(i, bytes([i]) * 6) for i in range(37)]


def test_videos_are_written(spark, tmp_path):
    spark.dataSource.register(video.Y4M)
    frames = packed_frames(spark, *FRAMES)
    for _ in range(2):
        assert sinks.write_y4m(frames.repartition(3), str(tmp_path / "v.y4m"), 20, 24) == 4
    again = spark.read.format("y4m").load(str(tmp_path / "v.y4m"))
    assert sorted((r.frame_id, bytes(r.data)) for r in again.collect()) == sorted((r.frame_id, bytes(r.data)) for r in frames.collect())
    assert [p.name for p in tmp_path.iterdir()] == ["v.y4m"]


def test_without_a_decoder(spark, tmp_path):
    spark.dataSource.register(video.Compressed)
    (tmp_path / "v.mp4").write_bytes(b"x")
    with pytest.raises(Exception, match="decoder|opened"):
        spark.read.format("video").load(str(tmp_path / "v.mp4")).collect()


def test_gaps_in_mosaics_are_zero(spark):
    rows = [(i, [0.0] * 64) for i in (0, 1, 63, 64, 130)]
    px = S.mosaics(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {r.frame_id: (r.n, r.lit) for r in px.groupBy("frame_id").agg(F.count("*").alias("n"), F.count_if(F.col("v") > 0).alias("lit")).collect()}
    assert got == {0: (4096, 192), 1: (4096, 64), 2: (4096, 64)}


def test_printed_frames_and_rates(spark):
    text = packed.printed(packed_frames(spark, np.array([[1, 20], [255, 0]]))).head().text
    assert text == "  1  20 \n255   0 \n"
    assert packed_frames(spark, STILL).select(packed.rate_text(F.lit(4.0)).alias("t")).head().t == "Fps: 250.00"


def test_rates_round_as_c_does(spark):
    """Halves, the doubles next to them, negative rates and ones far from 1: as Python's own %, which is C's."""
    half = (2 * np.arange(400) + 1) / 200
    rates = np.concatenate([half, np.nextafter(half, 9), np.nextafter(half, 0), -half, 8000 / np.arange(1, 13001), RNG.uniform(0, 1e6, 2000), 10 ** RNG.uniform(-9, 12, 2000)])
    took = spark.createDataFrame([(float(1000 / r),) for r in rates], "ms double")
    got = took.select("ms", packed.rate_text(F.col("ms")).alias("t")).collect()
    assert [r.t for r in got] == ["Fps: %.2f" % (1000 / r.ms) for r in got]
    assert spark.range(1).select(packed.rate_text(F.lit(None).cast("double")).alias("t")).head().t is None


def test_overlay_text_of_late_frames_is_its_sql(spark, tmp_path):
    """Frames 511, 2559 and 12799 have rates that end in half a hundredth; smaller tables have none."""
    duckdb = pytest.importorskip("duckdb")
    from motionframe.plans.queries import QUERIES, SQL

    rows = [(64 * f + 5, [0.1] * 64) for f in (0, 63, 510, 511, 512, 2559, 12799, 63999)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, QUERIES["overlay_text"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        assert got == sorted(con.execute(SQL["overlay_text"]).fetchall())


def test_command_line(spark, tmp_path, capsys):
    from motionframe.__main__ import main

    packed_frames(spark, *[np.kron(f, np.ones((3, 3), int)) for f in FRAMES]).write.parquet(str(tmp_path / "in"))
    assert main([str(tmp_path / "in"), "--format", "parquet"]) == 0
    assert len(capsys.readouterr().out.splitlines()) >= 2
    packed_frames(spark, STILL).where("false").write.parquet(str(tmp_path / "none"))
    assert main([str(tmp_path / "none"), "--format", "parquet"]) == 1


def test_shared_folder(spark, monkeypatch):
    from motionframe import shared

    assert shared.shared_dir(spark).endswith(spark.sparkContext.applicationId)

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master, applicationId = "yarn", "a"

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.shared_dir(Cluster)
    df = shared.written(spark.range(3), "t")
    shared.dropped(df)
    with pytest.raises(Exception):
        df.count()


def test_stages_are_written(spark, tmp_path):
    stages = D.binary_stages(pixel_table(spark, *FRAMES), SMALL, 20, 24, 0)
    sinks.write_stages({"threshold": stages["threshold"]}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "threshold")).count() == 3 * 480


def test_render(spark):
    frames = packed_frames(spark, *FRAMES)
    drawn = {r.frame_id: r for r in packed.render(frames, D.detect(frames, SMALL)).collect()}
    r = drawn[1]
    a = np.frombuffer(bytes(r.data), np.uint8).reshape(20, 48, 3)
    assert (a[:, :24] == FRAMES[1][..., None]).all() and a[8, 24 + 8].tolist() == [0, 0, 255] and r.text == "Detected"
    assert np.frombuffer(bytes(drawn[3].data), np.uint8).reshape(20, 48, 3)[:, 24:].tolist() == np.repeat(STILL[..., None], 3, 2).tolist()


def test_y4m(spark, tmp_path):
    path = tmp_path / "v.y4m"
    luma = [f.astype(np.uint8) for f in FRAMES]
    half = np.full((10, 12), 128, np.uint8)
    path.write_bytes(b"YUV4MPEG2 W24 H20 F50:1 C420jpeg\n" + b"".join(b"FRAME\n" + f.tobytes() + half.tobytes() * 2 for f in luma))
    spark.dataSource.register(video.Y4M)
    got = spark.read.format("y4m").option("framesPerTask", "3").load(str(path)).orderBy("frame_id").collect()
    assert [bytes(r.data) for r in got] == [np.repeat(f[..., None], 3, 2).tobytes() for f in luma]
    (tmp_path / "bad").write_bytes(b"no video")
    with pytest.raises(Exception, match="YUV4MPEG2"):
        spark.read.format("y4m").load(str(tmp_path / "bad")).collect()


def test_stream(spark, tmp_path):
    packed_frames(spark, *FRAMES).repartition(3).write.parquet(str(tmp_path / "in"))
    want = rows_of(D.detect(packed_frames(spark, *FRAMES), SMALL))
    stream = T.detect_stream(T.read_frames(spark, str(tmp_path / "in"), 1), STILL.astype(np.uint8), SMALL)
    T.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == want


def test_stream_learns_its_background(spark, tmp_path):
    from pyspark.sql import functions as F

    frames = packed_frames(spark, *FRAMES).withColumn("capture", F.lit("a"))
    frames.where("frame_id < 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: T.with_first_frame(spark.readStream.schema(f"{T.CAPTURED}").parquet(str(tmp_path / "in")), SMALL)
    T.run_to_end(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    frames.where("frame_id >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    T.run_to_end(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(D.detect(packed_frames(spark, *FRAMES), SMALL))


def test_queries_have_sql():
    from motionframe.plans.queries import QUERIES, SQL

    assert QUERIES.keys() == SQL.keys()


def test_library_stands_without_the_optional_part():
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name == 'corpus_pipeline' or name.startswith('motionframe.llm'):\n"
        "            raise ImportError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert 'abs_diff' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())\n"
        "assert e.oracle_sql()\n"
    )
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
