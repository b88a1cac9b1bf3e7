"""Experiments: a validated plan runs dataset, sampling, preprocessing, views, graph, method, evaluation, report.

Stages hand on checkpointed tables: plans stay short, and a lost executor costs the stage it was in. A seed sweep runs the plan for each seed.
"""

from __future__ import annotations

import copy
import json
import os
import re
import traceback
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.seeds import fingerprint
from tessera.operators import classifiers, deep, edges, metrics, propagate, sampling, selflabel, small, views
from tessera.operators.augment import weak_and_strong
from tessera.plans.cache import StepCache
from tessera.plans.hpo import Space, patched, search
from tessera.plans.limits import clipped
from tessera.plans.preprocess import PreprocessPlan, preprocess
from tessera.sources.catalog import load_dataset


class ConfigError(ValueError):
    pass


#: Accepted keys by section; others are errors.
KEYS = {
    "run": {"name", "seed", "seeds", "output_dir", "fail_fast", "log_level", "benchmark_mode", "allow_custom_factories"}, "limits": {"profile", "max_rows"}, "dataset": {"id", "options", "download", "cache_dir"}, "sampling": {"seed", "plan"},
    "preprocess": {"seed", "fit_on", "cache", "plan", "cache_dir"}, "views": {"seed", "plan"}, "graph": {"enabled", "seed", "cache", "cache_dir", "spec"}, "augmentation": {"enabled", "seed", "mode", "weak", "strong", "modality"},
    "method": {"kind", "id", "device", "params", "model"}, "evaluation": {"report_splits", "metrics", "split_for_model_selection"}, "search": {"enabled", "kind", "n_trials", "space", "seed", "repeats", "metric", "split"},
}
NEEDED = ("run", "dataset", "sampling", "preprocess", "method", "evaluation")


def expand(node: Any, env: dict[str, str] | None = None) -> Any:
    """${VAR} and $VAR from the environment; a missing one is an error, and $$ is a dollar."""
    env = dict(os.environ) if env is None else env
    if isinstance(node, dict):
        return {k: expand(v, env) for k, v in node.items()}
    if isinstance(node, list):
        return [expand(v, env) for v in node]
    if not isinstance(node, str):
        return node

    def of(m: re.Match) -> str:
        name = m[1] or m[2]
        if name is None:
            return "$"
        if name not in env:
            raise ConfigError(f"variable {name} is not set")
        return env[name]

    return re.sub(r"\$(?:\{(\w+)\}|([A-Za-z_]\w*)|\$)", of, node)


def validated(config: dict) -> dict:
    if extra := set(config) - set(KEYS):
        raise ConfigError(f"unknown sections {sorted(extra)}")
    if missing := [s for s in NEEDED if s not in config]:
        raise ConfigError(f"missing sections {missing}")
    for s, body in config.items():
        if extra := set(body) - KEYS[s]:
            raise ConfigError(f"unknown keys {sorted(extra)} in {s}")
    if config["method"].get("kind") not in ("inductive", "transductive"):
        raise ConfigError("method.kind is inductive or transductive")
    if config["method"]["id"] not in METHODS[config["method"]["kind"]]:
        raise ConfigError(f"unknown method {config['method']['id']!r}")
    unknown = set(config["evaluation"].get("metrics", [])) - set(metrics.METRICS)
    if unknown:
        raise ConfigError(f"unknown metrics {sorted(unknown)}")
    if config["method"]["kind"] == "transductive" and config["method"]["id"] not in ("tsvm",) and not config.get("graph", {}).get("enabled", "graph" in config):
        raise ConfigError("transductive methods need a graph")
    for s in ("preprocess", "graph"):
        if config.get(s, {}).get("cache") and not config[s].get("cache_dir"):
            raise ConfigError(f"{s}.cache needs {s}.cache_dir")
    if config["run"].get("benchmark_mode"):
        strict(config)
    return config


def strict(config: dict) -> None:
    """Benchmarks: no downloads, nothing automatic, nothing left to defaults that changes results."""
    def autos(node, path=""):
        if isinstance(node, dict):
            return [x for k, v in node.items() for x in autos(v, f"{path}.{k}")]
        return [path] if node == "auto" else []

    faults = [f"automatic {p[1:]}" for p in autos(config)]
    if config["dataset"].get("download", True):
        faults.append("downloads")
    if "fit_on" not in config["preprocess"]:
        faults.append("no preprocess.fit_on")
    if not config["evaluation"].get("report_splits"):
        faults.append("no report_splits")
    if not config["run"].get("fail_fast"):
        faults.append("no fail_fast")
    if not config["dataset"].get("cache_dir"):
        faults.append("no dataset.cache_dir")
    search_ = config.get("search", {})
    if search_.get("enabled"):
        chosen = config["evaluation"].get("split_for_model_selection")
        if not chosen:
            faults.append("no split_for_model_selection")
        if "test" in (chosen, search_.get("split")):
            faults.append("models selected on the test split")
    if faults:
        raise ConfigError("not for a benchmark: " + ", ".join(faults))


def sampling_plan(d: dict) -> sampling.SamplingPlan:
    split, lab, imb, pol = d.get("split", {}), d.get("labeling", {}), d.get("imbalance", {}), d.get("policy", {})
    return sampling.SamplingPlan(
        split=split.get("kind", "holdout"), test_fraction=split.get("test_fraction", 0.2), val_fraction=split.get("val_fraction", 0.1), k=split.get("k", 5), fold=split.get("fold", 0), stratify=split.get("stratify", True),
        labelling=sampling.Labelling(lab.get("mode", "fraction"), lab.get("value", 0.1), lab.get("strategy", "proportional"), lab.get("min_per_class", 1)),
        imbalance={"none": "none", "subsample_max_per_class": "cap", "cap": "cap", "long_tail": "long_tail"}[imb.get("kind", "none")], cap=imb.get("max_per_class", 0) or 0, alpha=imb.get("alpha", 0.5) or 0.5, imbalance_on={"labeled": "labelled"}.get(imb.get("apply_to", "train"), imb.get("apply_to", "train")),
        respect_official=pol.get("respect_official_test", True) and not pol.get("allow_override_official", False),
    )


def graph_spec(d: dict) -> edges.GraphSpec:
    d = {("block_rows" if k == "chunk_size" else k): v for k, v in d.items() if k not in ("backend", "feature_field", "cache")}
    w = d.pop("weights", {})
    w = {"kind": w} if isinstance(w, str) else w
    return edges.GraphSpec.from_dict({**d, **({"weights": w["kind"]} if "kind" in w else {}), **({"sigma": w["sigma"]} if "sigma" in w else {})})


def _propagation(f):
    return lambda ctx, p: f(ctx["edges"], ctx["observed"], ctx["n_classes"], **p)


def _selflabel(f):
    def go(ctx, p):
        return f(ctx["labelled"], ctx["pool"], ctx["n_classes"], base=ctx["base"], **p).scores(ctx["rows"])

    return go


def _supervised(ctx, p):
    return ctx["base"].fit(ctx["labelled"], ctx["n_classes"]).scores(ctx["rows"])


def _co(ctx, p):
    out = selflabel.co_training(ctx["labelled_views"], ctx["pool_views"], ctx["n_classes"], ("view_a", "view_b"), ctx["base"], **p)
    a, b = (m.scores(ctx["row_views"].select("id", F.col(v).alias("x"))) for m, v in zip(out["models"], ("view_a", "view_b"), strict=True))
    return a.join(b.select("id", F.col("x").alias("other")), "id").select("id", F.zip_with("x", "other", lambda p, q: (p + q) / 2).alias("x"))


def _tri(ctx, p):
    models = selflabel.tri_training(ctx["labelled"], ctx["pool"], ctx["n_classes"], ctx["base"], **p)["models"]
    got = ctx["rows"].select("id")
    for i, m in enumerate(models):
        got = got.join(classifiers.predicted(m.scores(ctx["rows"])).select("id", F.col("p").alias(f"p{i}")), "id")
    return selflabel.combined(got, [1.0] * 3, ctx["n_classes"])


def _democratic(ctx, p):
    bases = [classifiers.build(b) for b in p.pop("bases", ["gaussian_nb", "knn", "ridge"])]
    out = selflabel.democratic(ctx["labelled"], ctx["pool"], ctx["n_classes"], bases, **p)
    got = ctx["rows"].select("id")
    for i, m in enumerate(out["models"]):
        got = got.join(classifiers.predicted(m.scores(ctx["rows"])).select("id", F.col("p").alias(f"p{i}")), "id")
    return selflabel.combined(got, out["weights"], ctx["n_classes"])


def _s4vm(ctx, p):
    return selflabel.s4vm(ctx["labelled"], ctx["pool"], ctx["base"], **p).scores(ctx["rows"])


def _consistency(name):
    return lambda ctx, p: deep.train(name, ctx["labelled"], ctx["weak"], ctx["strong"], ctx["n_classes"], **p).scores(ctx["rows"])


def _network(f):
    return lambda ctx, p: f(ctx["edges"], ctx["rows"], ctx["observed"], ctx["n_classes"], ctx["width"], **p)


METHODS = {
    "transductive": {
        "label_propagation": _propagation(propagate.label_propagation), "label_spreading": _propagation(propagate.label_spreading), "laplace_learning": _propagation(propagate.laplace_learning), "poisson_learning": _propagation(propagate.poisson_learning),
        "poisson_mbo": _propagation(propagate.poisson_mbo), "p_laplace_learning": _propagation(propagate.p_laplace), "dynamic_label_propagation": _propagation(small.dynamic_label_propagation),
        "lazy_random_walk": lambda ctx, p: propagate.lazy_random_walk(ctx["edges"], ctx["observed"], **p), "graph_mincuts": lambda ctx, p: small.graph_mincut(ctx["edges"], ctx["observed"], **p),
        "tsvm": lambda ctx, p: small.tsvm(ctx["rows"].join(ctx["observed"], "id"), **p), "sgc": _network(deep.sgc), "gcn": _network(deep.gcn), "graphsage": _network(deep.graphsage), "n_gcn": _network(deep.n_gcn), "graphhop": _network(deep.graphhop), "chebnet": _network(deep.chebnet), "gcnii": _network(deep.gcnii), "gat": _network(deep.gat), "grand": _network(deep.grand), "h_gcn": _network(deep.h_gcn), "grafn": _network(deep.grafn),
        "planetoid": lambda ctx, p: deep.planetoid(ctx["edges"], ctx["rows"], ctx["observed"], ctx["n_classes"], **p),
        "appnp": lambda ctx, p: deep.appnp(ctx["edges"], ctx["rows"], ctx["observed"], ctx["n_classes"], **p),
    },
    "inductive": {
        "supervised": _supervised, "pseudo_label": _selflabel(selflabel.pseudo_label), "self_training": _selflabel(selflabel.self_training), "setred": _selflabel(selflabel.setred), "co_training": _co, "tri_training": _tri,
        "democratic_co_learning": _democratic, "s4vm": _s4vm, "trinet": lambda ctx, p: deep.trinet(ctx["labelled"], ctx["pool"], ctx["n_classes"], **p).scores(ctx["rows"]), "meta_pseudo_labels": lambda ctx, p: deep.meta_pseudo_labels(ctx["labelled"], ctx["pool"], ctx["n_classes"], **p).scores(ctx["rows"]),
        "deep_co_training": lambda ctx, p: deep.deep_co_training(ctx["labelled"], ctx["weak"], ctx["strong"], ctx["n_classes"], **p).scores(ctx["rows"]), **{m: _consistency(m) for m in deep.RULES},
    },
}
#: Names of parameters as configurations have them.
RENAMED = {"max_iter": "steps", "normalize_rows": None, "confidence_threshold": "threshold", "max_new_labels": "most", "min_new_labels": "least", "k_per_class": "k", "classifier_id": None, "classifier_backend": None, "classifier_params": None}


def _params(method: dict) -> dict:
    iterated = method["kind"] == "inductive" or method["id"] in ("laplace_learning", "poisson_learning", "lazy_random_walk")
    names = {**RENAMED, "max_iter": ("rounds" if method["kind"] == "inductive" else "max_iter") if iterated else "steps"}
    return {names.get(k, k): v for k, v in method.get("params", {}).items() if names.get(k, k) is not None}


def prepare(spark: SparkSession, config: dict) -> dict[str, Any]:
    """Everything up to the method."""
    seed = config["run"].get("seed", 0)
    data = load_dataset(spark, config["dataset"]["id"], config["dataset"].get("cache_dir"), config["dataset"].get("options"), config["dataset"].get("download", True))
    nodes = data["nodes"]
    if nodes.schema["y"].dataType.typeName() == "string":
        from tessera.operators.features import encode_labels

        nodes = encode_labels(nodes)
    official = "split" if nodes.filter("split = 'test'").limit(1).count() else None
    plan = sampling_plan(config["sampling"].get("plan", {}))
    nodes = propagate.cut(nodes)
    assignment = propagate.cut(sampling.sample(nodes, plan, "y", config["sampling"].get("seed", seed), official=official))
    scope = config["preprocess"].get("fit_on", "train_labeled")
    kept = StepCache(spark, config["preprocess"]["cache_dir"]) if config["preprocess"].get("cache") else None
    origin = fingerprint({"dataset": config["dataset"], "sampling": config["sampling"], "seed": seed, "fit_on": scope})
    ready = preprocess(nodes, PreprocessPlan.from_dict(config["preprocess"].get("plan", {})), lambda df: sampling.fit_scope(df, assignment, scope), config["preprocess"].get("seed", seed), (config["dataset"].get("options") or {}).get("modality", "tabular"), kept, origin)
    rows = propagate.cut(ready.data.select("id", "x"))
    width = rows.select(F.size("x").alias("n")).first()["n"]
    n_classes = int(assignment.agg(F.max("y").alias("m")).first()["m"]) + 1
    labelled = propagate.cut(rows.join(assignment.filter("is_labelled").select("id", "y"), "id"))
    pool = propagate.cut(rows.join(assignment.filter("part = 'train' and not is_labelled").select("id"), "id"))
    ctx: dict[str, Any] = {"assignment": assignment, "rows": rows, "labelled": labelled, "pool": pool, "n_classes": n_classes, "width": width, "prepared": ready, "observed": assignment.select("id", F.when(F.col("is_labelled"), F.col("y")).otherwise(-1).alias("y"))}
    if config.get("views") or config["method"]["id"] == "co_training":
        listed = [views.View(**v) for v in config.get("views", {}).get("plan", {}).get("views", [])] or views.two_views()
        chosen = views.resolve(listed, width, config.get("views", {}).get("seed", seed))
        both = dict(zip(("view_a", "view_b"), list(chosen.values())[:2], strict=True))
        of = lambda name, df: views.with_views(df, both) if kept is None else kept(fingerprint({"rows": ready.fingerprint, "views": chosen, "of": name}), lambda: views.with_views(df, both))
        ctx |= {"chosen": chosen, "row_views": of("rows", rows), "labelled_views": of("labelled", labelled), "pool_views": of("pool", pool)}
    if config.get("graph", {}).get("enabled", "graph" in config):
        spec = graph_spec(config["graph"].get("spec", {}))
        make = lambda: data["edges"] if "edges" in data else edges.build_graph(rows.join(assignment.select("id"), "id"), spec)
        if config["graph"].get("cache"):
            ctx["edges"] = StepCache(spark, config["graph"]["cache_dir"])(fingerprint({"rows": ready.fingerprint, "graph": spec.fingerprint()}), make)
        else:
            ctx["edges"] = propagate.cut(make())
    if config["method"]["id"] in {*deep.RULES, "deep_co_training"}:
        a = config.get("augmentation", {})
        steps = lambda k, d: [(s["id"], s.get("params", {})) for s in a.get(k, {}).get("steps", [])] or d
        both = weak_and_strong(pool, "x", steps("weak", [("core.identity", {})]), steps("strong", [("tabular.gaussian_noise", {})]), a.get("seed", seed))
        ctx |= {"weak": both.select("id", F.col("weak").alias("x")), "strong": both.select("id", F.col("strong").alias("x"))}
    p = config["method"].get("params", {})
    ctx["base"] = classifiers.build(p.get("classifier_id", "gaussian_nb"), **p.get("classifier_params", {}))
    return ctx


def fit_and_score(ctx: dict, config: dict) -> DataFrame:
    m = config["method"]
    return METHODS[m["kind"]][m["id"]](ctx, _params(m))


def measure(ctx: dict, scores: DataFrame, config: dict) -> dict[str, dict[str, float]]:
    ev, out = config["evaluation"], {}
    got = metrics.evaluate_parts(propagate.predictions(scores), ctx["assignment"].select("id", "y", "part"), ev.get("metrics", ["accuracy"]), ev.get("report_splits", ["val", "test"]))
    for r in got.collect():
        out.setdefault(r["part"], {})[r["metric"]] = r["value"]
    return out


def run_one(spark: SparkSession, config: dict, out_dir: str | None = None) -> dict:
    """The report of one seed; a failure is reported too, and raised if fail_fast asks for it."""
    started = datetime.now(UTC).isoformat()
    config = clipped(validated(expand(config)))
    report = {"run": {"name": config["run"].get("name", "run"), "seed": config["run"].get("seed", 0), "run_id": fingerprint(config)[:16], "started_at": started}, "config": config, "metrics": None, "hpo": None, "error": None}
    try:
        ctx = prepare(spark, config)
        s = config.get("search", {})
        if s.get("enabled"):
            def score(patch: dict, seed: int) -> float:
                tried = patched(config, patch)
                return measure(ctx, fit_and_score(ctx, tried), tried).get(s.get("split") or config["evaluation"].get("split_for_model_selection") or "val", {}).get(s.get("metric", "accuracy"), float("nan"))

            report["hpo"] = search(Space(s["space"]), score, s.get("kind", "grid"), s.get("n_trials", 10), s.get("seed", 0), s.get("repeats", 1))
            if report["hpo"]["best"]:
                config = validated(patched(config, report["hpo"]["best"]["params"]))
        report["metrics"] = measure(ctx, fit_and_score(ctx, config), config)
        report["artifacts"] = {"applied": ctx["prepared"].applied, "skipped": ctx["prepared"].skipped, "preprocess": ctx["prepared"].fingerprint}
        report["run"]["status"] = "success"
    except Exception as e:
        report["run"]["status"], report["error"] = "failed", "".join(traceback.format_exception(e))[-4000:]
        if config["run"].get("fail_fast"):
            raise
    finally:
        report["run"]["finished_at"] = datetime.now(UTC).isoformat()
        if out_dir:
            at = Path(out_dir) / f"{report['run']['name']}-{report['run']['run_id']}"
            at.mkdir(parents=True, exist_ok=True)
            (at / "run.json").write_text(json.dumps(report, indent=1, sort_keys=True, default=str))
            if report["hpo"]:
                (at / "trials.jsonl").write_text("".join(json.dumps(t) + "\n" for t in report["hpo"]["trials"]))
    return report


def with_seed(config: dict, seed: int) -> dict:
    """All sections' seeds replaced."""
    out = copy.deepcopy(config)
    out["run"] = {**out.get("run", {}), "seed": seed, "name": f"{out.get('run', {}).get('name', 'run')}-seed{seed}"}
    out["run"].pop("seeds", None)
    for s in ("sampling", "preprocess", "views", "graph", "augmentation", "search"):
        if s in out:
            out[s]["seed"] = seed
    return out


def sweep(spark: SparkSession, config: dict, out_dir: str | None = None) -> dict:
    """A run per seed, and the aggregate of those that succeed."""
    runs = [run_one(spark, with_seed(config, s), out_dir) for s in config["run"].get("seeds") or [config["run"].get("seed", 0)]]
    rows = [(r["run"]["name"], r["run"]["seed"], r["run"]["status"], part, m, float(v)) for r in runs for part, ms in (r["metrics"] or {"": {"": float("nan")}}).items() for m, v in ms.items()]
    table = spark.createDataFrame(rows, "run string, seed long, status string, split string, metric string, value double")
    return {"status": metrics.sweep_status(table).first()["status"], "summary": [r.asDict() for r in metrics.seed_sweep(table).collect()], "runs": runs}


