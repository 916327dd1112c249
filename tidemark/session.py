"""Session settings and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Settings:
    """Validated settings; each field can be set by an environment variable ``TIDEMARK_<FIELD>``."""

    data_dir: str = "data"
    n_boot: int = 1000
    seed: int = 20240101
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ if env is None else env)
        found = {k.removeprefix("TIDEMARK_").lower(): v for k, v in env.items() if k.startswith("TIDEMARK_")}
        n_boot, seed = int(found.pop("n_boot", cls.n_boot)), int(found.pop("seed", cls.seed))
        if n_boot < 1:
            raise ValueError("n_boot must be positive")
        return cls(found.pop("data_dir", cls.data_dir), n_boot, seed, found)


def build_session(name: str = "tidemark", master: str | None = None) -> SparkSession:
    """A session with UTC dates, ANSI errors and adaptive execution."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``; on a local master it may be unset, and a temporary folder serves."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = getattr(spark, "_tidemark_scratch", None) or "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark._tidemark_scratch = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
