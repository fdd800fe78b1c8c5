"""Extensions: callables of known kinds, registered with their limits and checked by one contract test."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of extensions: what each gets and gives (fixed values).
KINDS = {
    "extractor": "events -> claims",
    "retriever": "queries -> candidates (query_id, id, method, rank, evidence)",
    "consolidator": "groups of claims -> claims",
    "evaluator": "results -> one row of measures",
    "source": "nothing -> rows",
    "function": "a SQL function registered with the session",
}


@dataclass(frozen=True)
class Manifest:
    """What an extension says of itself."""

    name: str
    kind: str
    version: int
    columns: tuple[str, ...] = ()
    most_rows: int | None = None
    required: bool = True


class Registry:
    """The extensions of a session."""

    def __init__(self) -> None:
        self.loaded: dict[tuple[str, str], tuple[Manifest, Callable]] = {}

    def register(self, manifest: Manifest, call: Callable, spark: SparkSession | None = None) -> None:
        if manifest.kind not in KINDS:
            raise ValueError(f"no kind {manifest.kind}")
        old = self.loaded.get((manifest.kind, manifest.name))
        if old and old[0].version >= manifest.version:
            raise ValueError(f"{manifest.name} is there in version {old[0].version}")
        self.loaded[manifest.kind, manifest.name] = (manifest, call)
        if manifest.kind == "function" and spark is not None:
            spark.udf.register(manifest.name, call)

    def of(self, kind: str) -> list[tuple[Manifest, Callable]]:
        return [v for (k, _), v in sorted(self.loaded.items()) if k == kind]

    def checked(self, manifest: Manifest, out: DataFrame) -> DataFrame:
        """The columns an extension promised, and no more rows than it promised (as many as it may give, then an error)."""
        missing = [c for c in manifest.columns if c not in out.columns]
        if missing:
            raise ValueError(f"{manifest.name} lacks {missing}")
        out = out.select(*manifest.columns) if manifest.columns else out
        if manifest.most_rows is not None and out.limit(manifest.most_rows + 1).count() > manifest.most_rows:
            raise ValueError(f"{manifest.name} gave more than {manifest.most_rows} rows")
        return out

    def candidates(self, queries: DataFrame) -> tuple[DataFrame, list[str]]:
        """What all retrievers give for the queries, and which of the optional ones failed."""
        parts, failed = [], []
        for manifest, call in self.of("retriever"):
            try:
                parts.append(self.checked(manifest, call(queries)).withColumn("method", F.lit(manifest.name)))
            except Exception:
                if manifest.required:
                    raise
                failed.append(manifest.name)
        if not parts:
            raise ValueError("no retriever")
        return reduce(DataFrame.unionByName, parts), failed
