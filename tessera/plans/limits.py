"""Memory limits: a plan's batches, chunks and samples are clipped to what a profile allows."""

from __future__ import annotations

from typing import Any

from tessera.plans.hpo import leaves, patched

#: Rows at a time in preprocessing, in a method, in its base classifier, and in a block of the graph's construction.
PROFILES = {"v100": (32, 128, 64, 512), "h100": (64, 512, 256, 1024)}


def clipped(config: dict[str, Any]) -> dict[str, Any]:
    """The configuration with batch sizes, chunk sizes and the rows of a split at most what `limits` says."""
    limits = config.get("limits") or {}
    out: dict[str, Any] = {}
    if name := limits.get("profile"):
        if name not in PROFILES:
            raise ValueError(f"unknown profile {name!r}; there are {sorted(PROFILES)}")
        rows, method, base, chunk = PROFILES[name]
        most = lambda path: chunk if path == "graph.spec.chunk_size" else base if path.startswith("method.params.classifier_params.") else method if path.startswith("method.") else rows
        for path, value in leaves(config).items():
            if path.rpartition(".")[2] in ("batch_size", "chunk_size") and isinstance(value, int) and value > most(path):
                out[path] = most(path)
        if config.get("graph") and "graph.spec.chunk_size" not in leaves(config):
            out["graph.spec.chunk_size"] = chunk
    if (top := limits.get("max_rows")) is not None:
        given = (config["dataset"].get("options") or {}).get("limit")
        out["dataset.options"] = {**(config["dataset"].get("options") or {}), "limit": top if given is None else min(top, given)}
    return patched(config, out)
