"""Corpus files: JSON arrays of poems and authors, and tone annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POEM = "id string, title string, author string, rhythmic string, paragraphs array<string>"
AUTHOR = "name string, {bio} string"
PATH = "regexp_extract(input_file_name(), '([^/]+)$', 1)"


def _matching(spark: SparkSession, folder: str, prefix: str, suffix: str) -> list[str]:
    """Files of a folder by prefix and suffix, sorted by name, on any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isFile()]
    return [f"{folder}/{n}" for n in sorted(names) if n.startswith(prefix) and n.endswith(suffix)]


def read_poems(spark: SparkSession, folder: str, prefix: str, suffix: str = ".json", dataset: str = "poems", title: str = "title") -> DataFrame:
    """(title, author, paragraphs, upstream_id, dataset, file): poems of JSON arrays; those without paragraphs drop out.

    Values of a wrong type are null. title "rhythmic" reads song lyrics, whose tune is their title and whose id isn't kept."""
    paths = _matching(spark, folder, prefix, suffix)
    if not paths:
        return spark.createDataFrame([], "title string, author string, paragraphs array<string>, upstream_id string, dataset string, file string")
    raw = spark.read.schema(POEM).option("multiLine", True).option("mode", "PERMISSIVE").json(paths)
    kept = raw.where("paragraphs is not null and not exists(paragraphs, p -> p is null)")
    upstream = F.col("id") if title == "title" else F.lit(None).cast("string")
    return kept.select(F.col(title).alias("title"), "author", "paragraphs", upstream.alias("upstream_id"), F.lit(dataset).alias("dataset"), F.expr(PATH).alias("file"))


def read_authors(spark: SparkSession, folder: str, files: dict[str, tuple[str, str]]) -> DataFrame:
    """(name, bio, dynasty, file) of files {name: (bio key, dynasty)}; a file that isn't there is no error, a row without name drops out."""
    out = spark.createDataFrame([], "name string, bio string, dynasty string, file string")
    for file, (bio, dynasty) in files.items():
        for path in _matching(spark, folder, file, ""):
            rows = spark.read.schema(AUTHOR.format(bio=bio)).option("multiLine", True).option("ignoreMissingFiles", True).json(path)
            out = out.unionByName(rows.where("name is not null").select("name", F.col(bio).alias("bio"), F.lit(dynasty).alias("dynasty"), F.lit(file).alias("file")))
    return out


def read_tones(spark: SparkSession, folder: str) -> DataFrame:
    """(upstream_id, strains) of tone annotations."""
    rows = spark.read.schema("id string, strains array<string>").option("multiLine", True).json(folder)
    return rows.where("id is not null and strains is not null").select(F.col("id").alias("upstream_id"), "strains")
