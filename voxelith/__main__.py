"""Command line: python -m voxelith ingest|build|stage|search|plan|tasks|shards ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    from .plans.scene import STAGES

    out = argparse.ArgumentParser(prog="voxelith")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *needed: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        for option in needed:
            p.add_argument(f"--{option}", required=True)
        return p

    p = command("ingest", "sensor streams to frame folders", "root")
    p.add_argument("--sens", nargs="+", required=True)
    p.add_argument("--frame-skip", type=int, default=1)
    p.add_argument("--height", type=int, default=480)
    p.add_argument("--width", type=int, default=640)
    p.add_argument("--build", metavar="SCENE", help="build this scene afterwards")
    p.add_argument("--out", help="where to build it")
    p.add_argument("--force", action="store_true")
    p = command("build", "build a scene from frame folders", "root", "out", "scene")
    p.add_argument("--force", action="store_true")
    p = command("stage", "run one stage of a build", "root", "out", "scene")
    p.add_argument("name", choices=STAGES)
    for p in (sub.choices["build"], p, sub.choices["ingest"]):
        p.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE", help="parameters of the build, such as merge_mode=weighted")
    p = command("search", "search a scene by a text or an image", "out", "scene")
    p.add_argument("--text")
    p.add_argument("--image")
    p.add_argument("--k", type=int)
    p = command("plan", "list the files of a release", "base")
    p.add_argument("--scans", required=True, help="text file with one scan a line")
    p.add_argument("--test-scans", help="the same for the test scans")
    p.add_argument("--release", default="v2/scans")
    p.add_argument("--old-release", default="v1/scans")
    p.add_argument("--types", nargs="+", default=[".sens", ".txt"])
    p.add_argument("--test-types", nargs="+", default=[".sens", ".txt"])
    p.add_argument("--type", help="only this file type")
    p.add_argument("--id", help="only this scan")
    p.add_argument("--without-sens", action="store_true")
    p = command("tasks", "list task files: label map, frame archives and the like", "base", "release")
    p.add_argument("--names", nargs="+", required=True)
    command("shards", "list the record files", "base")
    return out


def configured(pairs: list[str]):
    """A build's parameters with some replaced, each read as the type of its default."""
    from .config import SceneConfig

    known, given = SceneConfig(), {}
    for pair in pairs:
        name, _, value = pair.partition("=")
        if not isinstance(getattr(known, name, None), (int, float, str)):
            raise ValueError(f"unknown parameter: {pair!r}")
        given[name] = type(getattr(known, name))(value)
    return SceneConfig(**given)


def main(argv: list[str] | None = None) -> None:
    from .models import GridSegmenter, HashEmbedder
    from .operators import manifest
    from .plans import scene
    from .sources import folders

    args = parser().parse_args(argv)
    if args.command == "ingest" and args.build and not args.out:
        raise SystemExit("--build needs --out")
    spark = SparkSession.builder.appName("voxelith").getOrCreate()
    if args.command == "ingest":
        print(f"{scene.ingest(spark, args.sens, args.root, args.frame_skip, args.height, args.width)} frames")
        if args.build:
            scene.build_scene(spark, args.root, args.out, args.build, GridSegmenter(), HashEmbedder(), configured(args.set), args.force)
    elif args.command == "build":
        scene.build_scene(spark, args.root, args.out, args.scene, GridSegmenter(), HashEmbedder(), configured(args.set), args.force)
    elif args.command == "stage":
        scene.run_stage(spark, args.name, args.root, args.out, args.scene, GridSegmenter(), HashEmbedder(), configured(args.set))
    elif args.command == "search":
        image = folders.picture(spark, args.image) if args.image else None
        scene.search_scene(spark, args.out, args.scene, HashEmbedder(), text=args.text, image=image, k=args.k).show(20, False)
    elif args.command == "plan":
        chosen = [manifest.checked_type(args.types, args.type), [t for t in args.test_types if args.type in (None, t)]]
        types, test_types = (spark.createDataFrame([(t,) for t in manifest.without_types(c, [".sens"] if args.without_sens else [])], "file_type string") for c in chosen)
        scans = manifest.scans_of(spark, args.scans)
        test = manifest.scans_of(spark, args.test_scans) if args.test_scans else scans.limit(0)
        out = manifest.release_plan(scans, test, types, test_types, args.base, args.release, args.old_release)
        (manifest.one_scan(out, args.id) if args.id else out).show(1000, False)
    elif args.command == "tasks":
        manifest.task_plan(spark, args.base, args.release, args.names).show(1000, False)
    else:
        manifest.shard_plan(spark, base=args.base).show(1000, False)


if __name__ == "__main__":
    main()
