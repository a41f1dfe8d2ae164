"""Layers by city and name: a catalogue with an error contract and a bounded store of opened layers; summaries and reports out."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layers that stay open (fixed value).
MOST_OPEN = 16


class UnknownCity(LookupError):
    """No such city: a server would answer 404."""


class NotBuilt(LookupError):
    """The city is known but the layer has not been built: a server would answer 503."""


class Layers:
    """Parquet layers under folder/city=.../layer=...; the most recently used stay open."""

    def __init__(self, spark: SparkSession, folder: str, cities: tuple[str, ...], most: int = MOST_OPEN):
        self.spark, self.folder, self.cities, self.most = spark, folder.rstrip("/"), cities, most
        self.open: OrderedDict[tuple[str, str], DataFrame] = OrderedDict()

    def _path(self, city: str, layer: str) -> str:
        return f"{self.folder}/city={city}/layer={layer}"

    def exists(self, city: str, layer: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(city, layer))
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def load(self, city: str, layer: str) -> DataFrame:
        if city.lower() not in self.cities:
            raise UnknownCity(city)
        key = (city.lower(), layer)
        if key not in self.open:
            if not self.exists(*key):
                raise NotBuilt(f"{key[0]}/{layer}")
            self.open[key] = self.spark.read.parquet(self._path(*key))
        self.open.move_to_end(key)
        while len(self.open) > self.most:
            self.open.popitem(last=False)
        return self.open[key]

    def save(self, df: DataFrame, city: str, layer: str) -> None:
        if city.lower() not in self.cities:
            raise UnknownCity(city)
        df.write.mode("overwrite").parquet(self._path(city.lower(), layer))
        self.open.pop((city.lower(), layer), None)


def write_summary(row: DataFrame, path: str) -> None:
    """A table of one row as one JSON document, nulls included."""
    row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).limit(1).write.mode("overwrite").text(path)


def profile_report(title: str, classes: DataFrame, attributes: DataFrame, fields: DataFrame) -> str:
    """A profile in Markdown. classes: kind, n, metres; attributes: of :func:`profile.attribute_profile`; fields: of :func:`profile.missing_fields`.

    All three have a row for each class, attribute or field, not for each feature.
    """
    out = [f"# {title}", "", "## Features by class", "", "| Class | Features | Length |", "|---|---:|---:|"]
    out += [f"| {r.kind} | {r.n:,} | {r.metres / 1000:.1f} km |" for r in classes.orderBy("kind").toLocalIterator()]
    out += ["", "## Attributes", "", "| Attribute | Filled | Example |", "|---|---:|---|"]
    for r in attributes.orderBy(F.desc("seen"), "name").toLocalIterator():
        example = r.example or ""
        out.append(f"| `{r.name}` | {r.filled:,}/{r.seen:,} | {example[:40] + '...' if len(example) > 40 else example} |")
    out += ["", "## Fields of the drainage model", ""]
    out += [f"- **{r.field}**: {'present' if r.present else 'not in the source, to be derived'}" for r in fields.orderBy("field").toLocalIterator()]
    return "\n".join([*out, ""])
