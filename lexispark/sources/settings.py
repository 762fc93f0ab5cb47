"""Settings from the environment, and files of a corpus by name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..plans.online import check_settings


@dataclass(frozen=True)
class ServiceSettings:
    """Settings of the online service; ``from_environment`` reads and checks them."""

    base_url: str
    token: str
    models: tuple[str, ...]
    origins: tuple[str, ...]
    retrieve_k: int = 100
    rerank_n: int = 10
    top_select: int = 5

    def __post_init__(self):
        check_settings(self.top_select, self.rerank_n, self.retrieve_k, self.base_url, self.origins, self.token)

    @classmethod
    def from_environment(cls, environment: Mapping[str, str], prefix: str = "SERVICE_") -> ServiceSettings:
        def need(name: str) -> str:
            value = environment.get(prefix + name, "").strip()
            if not value:
                raise ValueError(f"{prefix}{name} is required")
            return value

        def items(name: str) -> tuple[str, ...]:
            found = tuple(dict.fromkeys(v.strip() for v in need(name).split(",") if v.strip()))
            if not found:
                raise ValueError(f"{prefix}{name} names nothing")
            return found

        def number(name: str, default: int) -> int:
            raw = environment.get(prefix + name, str(default)).strip()
            if not raw.isdecimal() or int(raw) <= 0:
                raise ValueError(f"{prefix}{name} must be a positive number")
            return int(raw)

        return cls(need("BASE_URL"), need("TOKEN"), items("MODELS"), items("ORIGINS"), number("RETRIEVE_K", 100), number("RERANK_N", 10), number("TOP_SELECT", 5))


def corpus_files(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Names of the files right under ``root`` that match a pattern without separators, sorted; none is an error."""
    if "/" in pattern or "\\" in pattern:
        raise ValueError("the pattern must not contain a path separator")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    names = sorted(s.getPath().toString() for s in found if s.isFile())
    if not names:
        raise FileNotFoundError(f"no file matches {root}/{pattern}")
    return names
