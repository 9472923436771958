"""Fold tables, presence manifests and configurations."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.aggregates import normalised

# The habitat columns of a fold file, and view tokens in the order in which they are looked for.
HABITATS = "1 2 3 4 8 12 14 9_11 5_13_15 6_7".split()
VIEWS = ("Back", "Belly", "Side")


def stem_of(name: Column) -> Column:
    """A file name without its extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def view_of(stem: Column) -> Column:
    """The first view token in the stem; a stem without any fails the query."""
    found = F.lit(None).cast("string")
    for view in reversed(VIEWS):
        found = F.when(stem.contains(f"_{view}_"), F.lit(view)).otherwise(found)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no view in "), stem)))


def write_by_view(items: DataFrame, path: str) -> DataFrame:
    """items (stem, ...) as a table with a folder for each view, which stands for the view-wise directories; read again."""
    checked = items.withColumn("view", F.when(F.col("view").isin(*VIEWS), F.col("view")).otherwise(F.raise_error(F.concat(F.lit("no view: "), F.coalesce("view", F.lit("null"))))))
    checked.write.partitionBy("view").parquet(path)
    return items.sparkSession.read.schema(items.schema).parquet(path)


def kept_by_view(by_view: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of a view-partitioned table that the folds (stem, view) name; views that no fold has are pruned at run time."""
    return by_view.join(folds.select("stem", "view"), ["stem", "view"], "left_semi")


def read_fold(spark: SparkSession, path: str) -> DataFrame:
    """stem, family, habitat (shares that sum to 1, or zeros), view of a fold CSV."""
    schema = "name_of_img string, family string, " + ", ".join(f"`{h}` double" for h in HABITATS)
    raw = spark.read.csv(path, header=True, schema=schema)
    shares = normalised(F.array(*(F.col(f"`{h}`") / 100 for h in HABITATS)))
    stem = stem_of(F.col("name_of_img"))
    return raw.select(stem.alias("stem"), "family", shares.alias("habitat"), view_of(stem).alias("view"))


def read_presence(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    return spark.read.csv(path, header=True, schema="stem string, " + ", ".join(f"{c} boolean" for c in categories))


def load_config(path: str | Path) -> dict:
    """key: value lines; `includes: a, b` loads other files first; later keys win.

    Reads the flat subset of YAML that configurations use.
    """
    path = Path(path)
    own: dict = {}
    for line in path.read_text().splitlines():
        text = line.split("#", 1)[0].rstrip()
        if text and ":" in text and not text.startswith((" ", "-")):
            key, value = (x.strip() for x in text.split(":", 1))
            own[key] = _scalar(value)
    out: dict = {}
    for name in filter(None, (x.strip() for x in str(own.pop("includes", "") or "").strip("[]").split(","))):
        out |= load_config(path.parent / name)
    return out | own


def _scalar(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "": None}.get(text.lower(), text.strip("'\""))
