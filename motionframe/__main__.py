"""python -m motionframe SOURCE: the moving objects of a folder of images, a parquet table of packed frames or a Y4M video."""

from __future__ import annotations

import argparse
import sys

from motionframe.params import PROFILES


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="motionframe", description=__doc__)
    args.add_argument("source")
    args.add_argument("--format", choices=("images", "parquet", "y4m", "video"), default="images")
    args.add_argument("--profile", choices=sorted(PROFILES), default="cpu")
    args.add_argument("--out", help="write the boxes there as parquet instead of printing them")
    own = args.parse_args(argv)

    from pyspark.sql import SparkSession

    from motionframe.plans.detect import detect
    from motionframe.sources import frames, video

    spark = SparkSession.builder.appName("motionframe").getOrCreate()
    spark.dataSource.register(video.Y4M)
    spark.dataSource.register(video.Compressed)
    source = frames.read_images(spark, own.source) if own.format == "images" else spark.read.format(own.format).load(own.source)
    try:
        boxes = detect(source, PROFILES[own.profile])
        if own.out:
            boxes.write.parquet(own.out)
        else:
            for r in boxes.orderBy("frame_id", "label").toLocalIterator():
                print(r.frame_id, r.x, r.y, r.width, r.height)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
