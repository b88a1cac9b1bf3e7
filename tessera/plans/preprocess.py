"""Preprocessing plans: steps by id over named columns, resolved, then fitted and applied in order.

A step that is disabled, of another modality, or lacks its columns is skipped, with the reason recorded. Fitted steps
see only the rows of the fit scope. Unused columns cost nothing: Catalyst prunes them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.seeds import fingerprint, step_seed
from tessera.operators import augment, edges, features
from tessera.plans.cache import StepCache


class PlanError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    id: str
    params: dict = field(default_factory=dict)
    enabled: bool = True
    modalities: tuple[str, ...] = ()


@dataclass(frozen=True)
class PreprocessPlan:
    steps: tuple[Step, ...] = ()
    output_key: str = "x"

    @classmethod
    def from_dict(cls, d: dict) -> PreprocessPlan:
        if extra := set(d) - {"steps", "output_key"}:
            raise PlanError(f"unknown keys {sorted(extra)}")
        made = []
        for s in d.get("steps", []):
            if extra := set(s) - {"id", "params", "enabled", "modalities"}:
                raise PlanError(f"unknown keys {sorted(extra)}")
            if s["id"] not in STEPS:
                raise PlanError(f"unknown step {s['id']!r}")
            made.append(Step(s["id"], dict(s.get("params", {})), s.get("enabled", True), tuple(s.get("modalities", ()))))
        return cls(tuple(made), d.get("output_key", "x"))


@dataclass(frozen=True)
class Kind:
    """What a step needs and makes (`needs` may name a parameter), and how it is done: f(df, fit_rows, seed, params)."""

    f: Callable[..., DataFrame]
    needs: tuple[str, ...] = ("x",)
    fits: bool = False


def _plain(f: Callable[..., DataFrame], *needs: str) -> Kind:
    return Kind(lambda df, fit, seed, p: f(df, **p), needs or ("x",))


def _fitted(fit_f: Callable[..., Any], *needs: str) -> Kind:
    return Kind(lambda df, fit, seed, p: fit_f(fit, **p).apply(df), needs or ("x",), True)


def _onehot(df, fit, seed, p):
    return features.fit_onehot(fit, p["cols"]).apply(df)


def _impute(df, fit, seed, p):
    return features.fit_imputer(fit, **p).apply(df)


def _vocab(df, fit, seed, p):
    v = features.fit_vocabulary(fit, p.get("text", "text"), p.get("vocab", 30_000), p.get("min_freq", 1))
    return features.vocabulary_tokenized(df, p.get("text", "text"), v, p.get("length", 64))


def _tfidf(df, fit, seed, p):
    ng = tuple(p.get("ngrams", (1, 1)))
    idf = features.fit_idf(fit, p.get("text", "text"), ng, p.get("min_df", 1), p.get("max_df", 1.0), p.get("max_features"))
    rows = features.tfidf(df, p.get("text", "text"), idf, ng)
    return df.join(rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("tfidf")), "id", "left")


def _project(df, fit, seed, p):
    return features.random_projection(fit, p["k"], seed).apply(df)


def _stub(df, fit, seed, p):
    return features.auto_embedding(df, p.get("column", "text"), seed=seed)


def _same(df, fit, seed, p):
    return df


STEPS: dict[str, Kind] = {
    "core.ensure_2d": Kind(lambda df, fit, seed, p: features.ensure_2d(df, p.get("cols", ["x"])), ("cols",)), "core.copy_raw": Kind(lambda df, fit, seed, p: df.withColumn(p.get("out", "x"), F.col(p["column"])), ("column",)),
    "core.to_numpy": Kind(_same, ()), "core.to_torch": Kind(_same, ()), "labels.to_numpy": Kind(_same, ()), "labels.to_torch": Kind(_same, ()),
    "core.cast_dtype": Kind(lambda df, fit, seed, p: features.cast_vector(df, "x", p.get("dtype", "float32"))), "core.cast_fp16": Kind(lambda df, fit, seed, p: features.cast_vector(df, "x", "float16")),
    "core.pca": _fitted(features.fit_pca), "core.random_projection": Kind(_project, ("x",), True), "vision.zca_whitening": _fitted(features.fit_whitening),
    "tabular.one_hot": Kind(_onehot, ("cols",), True), "tabular.standard_scaler": _fitted(features.fit_scaler), "tabular.impute": Kind(_impute, ("cols",), True),
    "text.ensure_strings": Kind(lambda df, fit, seed, p: features.ensure_strings(df, p.get("text", "text")), ("text",)), "text.hash_tokenizer": Kind(lambda df, fit, seed, p: features.hash_tokenized(df, p.get("text", "text"), p.get("length", 64), p.get("vocab", 30_000)), ("text",)),
    "text.vocab_tokenizer": Kind(_vocab, ("text",), True), "text.tfidf": Kind(_tfidf, ("text",), True), "embeddings.auto": Kind(_stub, ("column",)),
    "labels.encode": Kind(lambda df, fit, seed, p: features.encode_labels(df, "y", split=p.get("split")), ("y",)), "labels.ensure_onehot": Kind(lambda df, fit, seed, p: features.onehot_labels(df, "y"), ("y",)),
    "vision.channels_order": _plain(features.channels_order, "image"), "vision.ensure_num_channels": _plain(features.with_channels, "image"), "vision.resize": _plain(features.resized, "image"), "vision.normalize": _plain(features.image_normalized, "image"),
    "vision.squeeze": Kind(lambda df, fit, seed, p: features.squeezed(df, "x")), "audio.load_waveform": _plain(features.wave_decoded, "content"), "audio.fixed_length": _plain(features.fixed_length, "wave"), "audio.log_mel_spectrogram": _plain(features.log_mel, "wave"),
}
#: Steps over edges rather than rows, by the same ids as elsewhere.
EDGE_STEPS = {"graph.attach_edge_weight": edges.with_weight, "graph.edge_sparsify": edges.sparsified, "graph.edge_dropout": augment.edge_dropout}
#: Frozen encoders are given by the caller: features.encoded takes any object with load() and encode().
ENCODERS = ("text.sentence_transformer", "vision.openclip", "audio.wav2vec2", "graph.dgi")


def register(name: str, kind: Kind) -> None:
    if name in STEPS:
        raise PlanError(f"{name} is taken")
    STEPS[name] = kind


@dataclass
class Prepared:
    data: DataFrame
    applied: list[str]
    skipped: dict[str, str]
    fingerprint: str


def preprocess(df: DataFrame, plan: PreprocessPlan, fit_rows: Callable[[DataFrame], DataFrame] | None = None, seed: int = 0, modality: str = "tabular", cache: StepCache | None = None, origin: str = "raw") -> Prepared:
    """fit_rows picks, of any state of the data, the rows that steps may fit on (SURVEY: fit scope).

    With a cache, the output of each step is kept by the fingerprint of the data's origin and of all steps up to it; what
    is found there is neither fitted nor applied again.
    """
    applied, skipped, print_ = [], {}, origin
    for i, step in enumerate(plan.steps):
        kind = STEPS[step.id]
        name = f"{i}:{step.id}"
        needs = [c for n in kind.needs for c in (lambda v: v if isinstance(v, list) else [v])(step.params.get(n, n))]
        if kind.needs == ("cols",) and "cols" not in step.params:
            needs = ["x"]
        missing = [c for c in needs if c not in df.columns]
        if not step.enabled:
            skipped[name] = "disabled"
        elif step.modalities and modality not in step.modalities:
            skipped[name] = f"modality {modality}"
        elif missing:
            skipped[name] = f"missing {missing}"
        elif kind.fits and fit_rows is None:
            raise PlanError(f"{step.id} needs rows to fit on")
        else:
            own = step_seed(seed, i, step.id)
            print_ = fingerprint({"before": print_, "step": step.id, "params": step.params, "seed": own})
            make = lambda kind=kind, df=df, own=own, step=step: kind.f(df, fit_rows(df) if kind.fits else None, own, step.params)
            df = make() if cache is None else cache(print_, make)
            applied.append(name)
    if plan.output_key not in ("x", None) and plan.output_key in df.columns:
        df = df.withColumn("x", F.col(plan.output_key))
    return Prepared(df, applied, skipped, print_)
