"""What a deployment chooses by name: how words become terms, which catalog is read, which features and reducers are
computed. Names come from the session's configuration (``spanweave.terms`` and so on); a missing or unknown one is
an error. Further choices are added to the tables below."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions import text
from spanweave.functions.stemmer import stemmed
from spanweave.sources import catalogs

TERM_PROCESSORS: dict[str, Callable[[Column], Column]] = {"lower": text.term, "english": lambda w: stemmed(text.term(w))}
CATALOGS: dict[str, Callable[..., dict[str, DataFrame]]] = {"tsv": catalogs.tsv_catalog, "rdf": catalogs.rdf_catalog}
#: Of snippets' feature vectors: the value of a feature for an entity.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "support": lambda fv: F.count("*").cast("double"),
    "total": lambda fv: F.sum(F.aggregate(fv, F.lit(0.0), lambda s, x: s + x)),
    "strongest": lambda fv: F.max(F.array_max(fv)),
}
REDUCERS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": F.count, "least": F.min, "greatest": F.max}


class Settings:
    """Reads names under ``spanweave.`` and looks up what they stand for."""

    def __init__(self, values: Mapping[str, str]):
        self.values = values

    @classmethod
    def of(cls, spark: SparkSession, **instead: str) -> Settings:
        """The session's settings, with some given here in their place."""
        return cls({**spark.conf.getAll, **{f"spanweave.{k}": v for k, v in instead.items()}})

    def get(self, key: str) -> str:
        if f"spanweave.{key}" not in self.values:
            raise KeyError(f"spanweave.{key} is not set")
        return self.values[f"spanweave.{key}"]

    def _named(self, key: str, table: dict) -> list:
        names = [n.strip() for n in self.get(key).split(",")]
        if missing := [n for n in names if n not in table]:
            raise KeyError(f"no such {key}: {', '.join(missing)}")
        return [table[n] for n in names]

    def term_processor(self) -> Callable[[Column], Column]:
        return self._named("terms", TERM_PROCESSORS)[0]

    def catalog(self) -> Callable[..., dict[str, DataFrame]]:
        return self._named("catalog", CATALOGS)[0]

    def features(self, fv: Column) -> list[Column]:
        """The chosen features as aggregates, named as they are chosen."""
        names = [n.strip() for n in self.get("features").split(",")]
        return [f(fv).alias(n) for n, f in zip(names, self._named("features", FEATURES), strict=True)]

    def reducer(self) -> Callable[[Column], Column]:
        return self._named("reducer", REDUCERS)[0]
