"""Sources: URIs, a catalog of keys, providers that read canonical tables.

A provider gives tables: nodes (id, x or text or path, y, split) and, for graphs, edges (src, dst, w). What the curated
keys name lies on servers; offline they are read from files of the same layout (option `path`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.seeds import normal, ticket, uniform
from tessera.functions.vectors import as_double
from tessera.operators.edges import induced
from tessera.sources.store import Store


class SourceError(ValueError):
    pass


def parse_uri(uri: str) -> tuple[str, str]:
    provider, colon, reference = uri.partition(":")
    if not colon or not provider.strip() or not reference.strip():
        raise SourceError(f"{uri!r} is no provider:reference")
    return provider.strip(), reference.strip()


@dataclass(frozen=True)
class Entry:
    key: str
    uri: str
    modality: str
    task: str = "classification"
    options: dict = field(default_factory=dict)


def _entries() -> list[Entry]:
    #: The curated keys by modality, with their providers.
    keys = {
        "tabular": ("openml", ["iris", "adult", "breast_cancer"]),
        "text": ("hf", ["ag_news", "imdb", "amazon_polarity", "amazon_reviews_multi_en", "dbpedia_14", "yelp_polarity", "yelp_review_full"]),
        "vision": ("torchvision", ["mnist", "cifar10", "cifar100", "svhn", "stl10"]),
        "graph": ("pyg", ["cora", "citeseer", "pubmed"]),
        "audio": ("torchaudio", ["speechcommands", "yesno"]),
    }
    return [Entry("toy", "toy:default", "tabular"), *[Entry(k, f"{p}:{k}", m) for m, (p, names) in keys.items() for k in names]]


CATALOG = {e.key: e for e in _entries()}


def keys(include: list[str] | None = None, exclude: list[str] | None = None, modalities: list[str] | None = None) -> list[str]:
    for k in [*(include or []), *(exclude or [])]:
        if k not in CATALOG:
            raise SourceError(f"unknown dataset {k!r}")
    return sorted(k for k, e in CATALOG.items() if (not include or k in include) and k not in (exclude or []) and (not modalities or e.modality in modalities))


def catalog_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e.key, e.uri, e.modality, e.task) for _, e in sorted(CATALOG.items())], "key string, uri string, modality string, task string")


def identity(dataset: str, options: dict | None = None) -> dict:
    """Resolved: the catalog's options under the request's; a URI passes."""
    if dataset in CATALOG:
        e = CATALOG[dataset]
        return {"uri": e.uri, "modality": e.modality, "task": e.task, "options": {**e.options, **(options or {})}}
    provider, reference = parse_uri(dataset)
    return {"uri": f"{provider}:{reference}", "modality": (options or {}).get("modality", "tabular"), "task": "classification", "options": options or {}}


def class_filter(df: DataFrame, classes, y: str = "y") -> DataFrame:
    if classes is None:
        return df
    return df.filter(F.col(y).isin(*(classes if isinstance(classes, (list, tuple)) else [classes])))


def sample_limit(df: DataFrame, n: int | None, seed: int | None = None, id_col: str = "id") -> DataFrame:
    """The first n by id, or by ticket if there is a seed; after the class filter."""
    if n is None:
        return df
    if n <= 0:
        return df.limit(0)
    return df.orderBy(*([id_col] if seed is None else [ticket(seed, "limit", id_col), id_col])).limit(n)


def limited(nodes: DataFrame, options: dict) -> DataFrame:
    """Filter, then limit of each split; the test split's seed is one more."""
    nodes = class_filter(nodes, options.get("class_filter"))
    n, seed = options.get("limit"), options.get("seed")
    if n is None:
        return nodes
    parts = [sample_limit(nodes.filter(F.col("split") == s), n, None if seed is None else seed + k) for k, s in enumerate(("train", "test"))]
    return parts[0].unionByName(parts[1])


def toy(spark: SparkSession, reference: str, o: dict) -> dict[str, DataFrame]:
    """N(0, 1) features and uniform labels; the last rows are the official test."""
    n, d, c, seed = o.get("n_samples", 64), o.get("n_features", 4), o.get("n_classes", 3), o.get("seed", 0)
    size = o.get("test_size", 0.25)
    n_test = round(n * size) if isinstance(size, float) and size < 1 else int(size or 0)
    rows = spark.range(n).select("id", F.array(*[normal(seed, f"toy{i}", "id") for i in range(d)]).alias("x"), F.floor(uniform(seed, "toy/y", "id") * c).cast("int").alias("y"), F.when(F.col("id") >= n - n_test, "test").otherwise("train").alias("split"))
    return {"nodes": rows}


def _read(spark: SparkSession, path: str, fmt: str | None, o: dict) -> DataFrame:
    kind = fmt or path.rstrip("/").rpartition(".")[2]
    reader = spark.read.options(**{k: str(v) for k, v in o.get("read_options", {}).items()})
    if kind == "csv":
        return reader.csv(path, header=True, schema=o["schema"]) if "schema" in o else reader.csv(path, header=True, inferSchema=True)
    if kind in ("json", "jsonl"):
        return reader.json(path, schema=o.get("schema"))
    if kind in ("parquet", "orc"):
        return reader.format(kind).load(path)
    raise SourceError(f"cannot read {path}")


def _split(df: DataFrame, o: dict) -> DataFrame:
    """Official test: `test`, else `validation` (the other way with prefer_test_split off)."""
    column = o.get("split_column")
    if column is None:
        return df.withColumn("split", F.lit("train"))
    order = ["test", "validation"] if o.get("prefer_test_split", True) else ["validation", "test"]
    there = df.agg(*[F.coalesce(F.max(F.col(column) == s), F.lit(False)).alias(s) for s in order]).first()
    test = next((s for s in order if there[s]), None)
    return df.withColumn("split", F.when(F.col(column) == test, "test").when(F.col(column) == "train", "train") if test else F.when(F.col(column) == "train", "train")).filter("split is not null")


def _numbered(df: DataFrame, o: dict) -> DataFrame:
    """Rows need an id: a column, or the hash of the row (rows that are equal share it)."""
    if "id_column" in o:
        return df.withColumn("id", F.col(o["id_column"]).cast("long"))
    return df.withColumn("id", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))


def tabular(spark: SparkSession, reference: str, o: dict) -> dict[str, DataFrame]:
    df = _split(_numbered(_read(spark, o.get("path", reference), o.get("format"), o), o), o)
    y = o.get("label_column", "label")
    feats = o.get("feature_columns") or [c for c in df.columns if c not in (y, "id", "split", o.get("id_column"), o.get("split_column"))]
    return {"nodes": df.select("id", *feats, F.col(y).alias("y"), "split")}


def text(spark: SparkSession, reference: str, o: dict) -> dict[str, DataFrame]:
    df = _split(_numbered(_read(spark, o.get("path", reference), o.get("format"), o), o), o)
    return {"nodes": df.select("id", F.col(o.get("text_column", "text")).cast("string").alias("text"), F.col(o.get("label_column", "label")).alias("y"), "split")}


def files(spark: SparkSession, reference: str, o: dict) -> dict[str, DataFrame]:
    """Files in a folder per class (label: the parent's name, or the first digit of a file's name), with their bytes."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", o.get("glob", "*")).load(o.get("path", reference))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    y = F.regexp_extract(name, r"^(\d)", 1).cast("int") if o.get("label_from") == "first_digit" else F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    split = F.when(F.col("path").rlike(r"/test(ing)?/"), "test").otherwise("train")
    return {"nodes": df.select(F.xxhash64("path").alias("id"), "path", "content", y.alias("y"), split.alias("split"))}


def graph(spark: SparkSession, reference: str, o: dict) -> dict[str, DataFrame]:
    """A table of nodes (id, x, y, masks) and one of edges (src, dst, maybe w); missing labels become -1. A class filter takes the induced subgraph."""
    nodes = _read(spark, o["nodes_path"], o.get("format"), o)
    edges = _read(spark, o["edges_path"], o.get("format"), o)
    nodes = nodes.withColumns({"y": F.coalesce("y", F.lit(-1)), "x": as_double("x")})
    edges = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))
    if o.get("class_filter") is not None:
        nodes = class_filter(nodes, o["class_filter"])
        ids, edges = induced(edges, nodes)
        nodes = nodes.join(ids, "id").drop("id").withColumnRenamed("new_id", "id")
    return {"nodes": nodes if "split" in nodes.columns else nodes.withColumn("split", F.lit("train")), "edges": edges}


Provider = Callable[[SparkSession, str, dict], dict[str, DataFrame]]
#: By the scheme of a URI; the last are plain files and tables.
PROVIDERS: dict[str, Provider] = {"toy": toy, "openml": tabular, "hf": text, "tfds": text, "torchvision": files, "torchaudio": files, "pyg": graph, "table": tabular, "text": text, "files": files, "graph": graph}


def register(name: str, provider: Provider) -> None:
    if name in PROVIDERS:
        raise SourceError(f"{name} is taken")
    PROVIDERS[name] = provider


def read(spark: SparkSession, dataset: str, options: dict | None = None) -> dict[str, DataFrame]:
    who = identity(dataset, options)
    provider, reference = parse_uri(who["uri"])
    if provider not in PROVIDERS:
        raise SourceError(f"unknown provider {provider!r}")
    if dataset in CATALOG and provider != "toy" and not {"path", "nodes_path"} & set(who["options"]):
        raise SourceError(f"{dataset} lies on a server; give a path to files of it")
    tables = PROVIDERS[provider](spark, reference, who["options"])
    if "edges" not in tables:
        tables["nodes"] = limited(tables["nodes"], who["options"])
    return tables


def load_dataset(spark: SparkSession, dataset: str, root: str | None = None, options: dict | None = None, download: bool = True, force: bool = False) -> dict[str, DataFrame]:
    """From the store, filled if need be; without a root, straight from the source."""
    if root is None:
        return read(spark, dataset, options)
    store = Store(spark, root)
    key = store.cached(identity(dataset, options), lambda: read(spark, dataset, options), download, force)
    return {t: store.get(key, t) for t in store.manifest(key)["tables"]}


def download_all(spark: SparkSession, root: str, include=None, exclude=None, modalities=None, options: dict[str, dict] | None = None, skip_cached: bool = True) -> DataFrame:
    """(key, status, detail): a failure of one key leaves the others alone."""
    report, store = [], Store(spark, root)
    for k in keys(include, exclude, modalities):
        own = (options or {}).get(k)
        try:
            if skip_cached and store.manifest(store.key(identity(k, own))):
                report.append((k, "cached", None))
                continue
            store.cached(identity(k, own), lambda k=k, own=own: read(spark, k, own))
            report.append((k, "done", None))
        except Exception as e:  # noqa: BLE001
            report.append((k, "failed", str(e)[:500]))
    return spark.createDataFrame(report, "key string, status string, detail string")
