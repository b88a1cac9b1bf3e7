"""Command line: python -m tessera.plans.cli GROUP ACTION ..., output as JSON or a table."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def session() -> SparkSession:
    return SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _config(path: str) -> dict:
    text = open(path).read()
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def build() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    groups = top.add_subparsers(dest="group", required=True)

    def group(name: str, **actions: list[tuple[str, dict]]):
        sub = groups.add_parser(name).add_subparsers(dest="action", required=True)
        for action, args in actions.items():
            p = sub.add_parser(action)
            for flag, kw in args:
                p.add_argument(flag, **kw)

    many = {"nargs": "*"}
    group("datasets", list=[("--modality", many)], info=[("dataset", {})], download=[("--root", {"required": True}), ("--include", many), ("--exclude", many)], cached=[("--root", {"required": True})], purge=[("--root", {"required": True}), ("fingerprint", {})], gc=[("--root", {"required": True})])
    group("sampling", run=[("--nodes", {"required": True}), ("--out", {"required": True}), ("--plan", {}), ("--seed", {"type": int, "default": 0})], validate=[("--assignment", {"required": True}), ("--nodes", {"required": True})], show=[("--assignment", {"required": True})])
    group("preprocess", steps=[], run=[("--nodes", {"required": True}), ("--plan", {"required": True}), ("--out", {"required": True}), ("--seed", {"type": int, "default": 0})])
    group("graph", build=[("--nodes", {"required": True}), ("--out", {"required": True}), ("--spec", {}), ("--shards", {"type": int, "default": 8})], summary=[("--edges", {"required": True}), ("--nodes", {"required": True})])
    group("augmentation", list=[])
    group("inductive", list=[])
    group("transductive", list=[])
    group("supervised", list=[])
    group("evaluation", list=[], compute=[("--predictions", {"required": True}), ("--metrics", {"nargs": "+", "default": ["accuracy"]})])
    group("bench", run=[("--config", {"required": True}), ("--out", {"default": "runs"})], validate=[("--config", {"required": True})])
    group("doctor", check=[])
    return top


def main(argv: list[str] | None = None) -> int:
    a = build().parse_args(argv)
    what = (a.group, a.action)
    show = lambda x: print(json.dumps(x, indent=1, sort_keys=True, default=str))
    from tessera.operators import augment, classifiers, metrics
    from tessera.plans import preprocess, run
    from tessera.sources import catalog

    if what == ("datasets", "list"):
        show(catalog.keys(modalities=a.modality))
    elif what == ("datasets", "info"):
        show(catalog.identity(a.dataset))
    elif what == ("preprocess", "steps"):
        show(sorted(preprocess.STEPS))
    elif what == ("augmentation", "list"):
        show(sorted([*augment.OPS, *augment.IMAGE_OPS, "graph.edge_dropout"]))
    elif a.group in ("inductive", "transductive"):
        show(sorted(run.METHODS[a.group]))
    elif what == ("supervised", "list"):
        show(sorted([*classifiers.CLASSIFIERS, *classifiers.DEEP]))
    elif what == ("evaluation", "list"):
        show(sorted(metrics.METRICS))
    elif what == ("bench", "validate"):
        run.validated(run.expand(_config(a.config)))
        show("ok")
    elif a.group == "doctor":
        import importlib.util

        show({m: importlib.util.find_spec(m) is not None for m in ("pyspark", "pandas", "pyarrow", "numpy", "yaml")})
    else:
        return _with_spark(what, a, show)
    return 0


def _with_spark(what: tuple[str, str], a: argparse.Namespace, show) -> int:
    from tessera.operators import edges, metrics, sampling
    from tessera.plans import preprocess, run
    from tessera.sources import catalog, store

    spark = session()
    read = spark.read.parquet
    if what == ("datasets", "download"):
        show([r.asDict() for r in catalog.download_all(spark, a.root, a.include, a.exclude).collect()])
    elif what == ("datasets", "cached"):
        show(store.Store(spark, a.root).index())
    elif what == ("datasets", "purge"):
        store.Store(spark, a.root).purge(a.fingerprint)
    elif what == ("datasets", "gc"):
        show(store.Store(spark, a.root).collect_garbage())
    elif what == ("sampling", "run"):
        plan = run.sampling_plan(_config(a.plan) if a.plan else {})
        store.save_split(sampling.sample(read(a.nodes), plan, "y", a.seed), a.out)
    elif what == ("sampling", "validate"):
        bad = sampling.violations(read(a.assignment), read(a.nodes)).first().asDict()
        show(bad)
        return int(any(bad.values()))
    elif what == ("sampling", "show"):
        show([r.asDict() for r in sampling.stats(read(a.assignment), "y").collect()])
    elif what == ("preprocess", "run"):
        preprocess.preprocess(read(a.nodes), preprocess.PreprocessPlan.from_dict(_config(a.plan)), lambda df: df, a.seed).data.write.parquet(a.out)
    elif what == ("graph", "build"):
        store.save_edges(edges.build_graph(read(a.nodes), run.graph_spec(_config(a.spec) if a.spec else {})), a.out, a.shards)
    elif what == ("graph", "summary"):
        show(edges.degree_summary(read(a.edges), read(a.nodes)).first().asDict())
    elif what == ("evaluation", "compute"):
        show({r["metric"]: r["value"] for r in metrics.evaluate(read(a.predictions), a.metrics).collect()})
    elif what == ("bench", "run"):
        out = run.sweep(spark, _config(a.config), a.out)
        show({k: out[k] for k in ("status", "summary")})
        return int(out["status"] == "failed")
    return 0


if __name__ == "__main__":
    sys.exit(main())
