"""Stored documents and chunks: scan, write, look up, delete, expire, write back, fixtures, samples.

Tables are Parquet folders with a folder per load. A write lays down chunks first and documents last, so a
document row is the sign that all of its load's chunks are there; readers take chunks through the documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import extraction

DEFAULT_TTL_HOURS = 24


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page table ``(doc_id, page, text)`` from Parquet, JSON lines or CSV."""
    reader = spark.read.schema(schemas.PAGES)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(fmt).load(path)


#: Tasks for a split of a table whose short rows are unfolded into long texts: splits are cut by bytes of the files.
UNFOLDED = 16


def spread(rows: DataFrame, key: str, per_split: int = 1) -> DataFrame:
    """Give text-heavy work a task per core when the files come in fewer splits; a no-op on a large table.

    With ``per_split`` it has so many tasks for each split, so that their rows do not grow with the table.
    """
    splits = rows.rdd.getNumPartitions()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, splits * per_split)
    return rows if splits >= tasks else rows.repartition(tasks, key)


def cut_into_pages(documents: DataFrame, lines_per_page: int = 8) -> DataFrame:
    """Pages of one-row documents ``(doc_id, text)``: every ``lines_per_page`` lines, without a shuffle."""

    def cut(lines: Column) -> Column:
        count = F.ceil(F.size(lines) / lines_per_page).cast("int")
        return F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda p: F.array_join(F.slice(lines, p * lines_per_page + 1, F.lit(lines_per_page)), "\n"),
        )

    # the lines are bound to a name: they would be made again for every page
    pages = F.get(F.transform(F.array(F.split("text", "\n", -1)), cut), 0)
    return documents.select("doc_id", F.posexplode(pages).alias("p", "text")).select(
        "doc_id", (F.col("p") + 1).alias("page"), "text"
    )


def expiry(created_at: Column, ttl_hours: float = DEFAULT_TTL_HOURS) -> Column:
    return created_at + F.make_dt_interval(secs=F.lit(ttl_hours * 3600))


def document_rows(documents: DataFrame, chunks: DataFrame, created_at: Column, ttl_hours: float = DEFAULT_TTL_HOURS) -> DataFrame:
    """Add ``chunk_count``, ``created_at`` and ``expires_at`` to document rows."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    return (
        documents.join(counts, "doc_id", "left")
        .fillna(0, ["chunk_count"])
        .withColumn("created_at", created_at)
        .withColumn("expires_at", expiry(created_at, ttl_hours))
    )


def write_documents(documents: DataFrame, chunks: DataFrame, root: str, load_id: str) -> None:
    """Chunks first, documents last as the commit marker; chunks are clustered by document for later reads.

    A load replaces what an earlier attempt with the same ``load_id`` left, so a retried write is harmless.
    """
    placed = chunks.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index")
    placed.write.mode("overwrite").parquet(f"{root}/chunks/load_id={load_id}")
    documents.write.mode("overwrite").parquet(f"{root}/documents/load_id={load_id}")


def read_documents(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``(documents, chunks)`` of all finished loads; chunks of an unfinished one stay invisible."""
    documents = spark.read.parquet(f"{root}/documents")
    chunks = spark.read.parquet(f"{root}/chunks")
    return documents, chunks.join(documents.select("doc_id", "load_id"), ["doc_id", "load_id"], "left_semi")


def find_documents(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents by id; ``ids(doc_id)`` is a table of any size."""
    return documents.join(ids, "doc_id", "left_semi")


def find_by_slug(documents: DataFrame, slug: str) -> DataFrame:
    return documents.filter(F.col("is_sample") & (F.col("sample_slug") == slug))


def list_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks of the wanted documents without their vectors, in index order."""
    wanted = chunks.drop("embedding", "tsv").join(ids, "doc_id", "left_semi")
    return wanted.orderBy("doc_id", "chunk_index")


def find_chunks(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Chunks by ``(doc_id, chunk_id)``."""
    return chunks.drop("embedding").join(keys, ["doc_id", "chunk_id"], "left_semi")


def delete_documents(ids: DataFrame, documents: DataFrame, *dependents: DataFrame) -> tuple[DataFrame, ...]:
    """What is left after deleting non-sample documents: ``(documents, *dependents)``, cascaded."""
    gone = documents.filter(~F.col("is_sample")).join(ids, "doc_id", "left_semi").select("doc_id")
    return tuple(t.join(gone, "doc_id", "left_anti") for t in (documents, *dependents))


def expired(documents: DataFrame, as_of: Column) -> DataFrame:
    return documents.filter((F.col("expires_at") < as_of) & ~F.col("is_sample"))


def purge_expired(as_of: Column, documents: DataFrame, *dependents: DataFrame) -> tuple[DataFrame, ...]:
    """What is left after the purge: one filter on documents, the cascade on their dependents."""
    keep = documents.filter(F.coalesce(~((F.col("expires_at") < as_of) & ~F.col("is_sample")), F.lit(True)))
    gone = expired(documents, as_of).select("doc_id")
    return (keep, *(t.join(gone, "doc_id", "left_anti") for t in dependents))


def write_back(documents: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Overwrite ``columns`` where the update brings a value; other documents stay as they are."""
    renamed = updates.select("doc_id", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = documents.join(renamed, "doc_id", "left")
    out = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in documents.columns]
    return joined.select(*out)


def fixture_rows(cache: DataFrame, digits: int = 6) -> DataFrame:
    """Cache rows with components rounded for export, halves up."""
    scale = float(10**digits)
    rounded = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale + 0.5) / scale)
    return cache.select("content_hash", "model", rounded.alias("embedding"))


def export_fixture(cache: DataFrame, path: str) -> None:
    """JSON lines in key order across files."""
    fixture_rows(cache).orderBy("content_hash").write.mode("overwrite").json(path)


def import_fixture(cache: DataFrame, path: str) -> DataFrame:
    """Cache plus fixture rows whose key is absent; a missing file adds nothing."""
    try:
        rows = cache.sparkSession.read.schema(schemas.EMBEDDING_CACHE).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return cache
    return insert_if_absent(cache, rows, "content_hash")


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    fresh = rows.dropDuplicates([key]).join(table.select(key), key, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def sample_catalogue(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Sample index with ``doc_id`` and ``loaded``."""
    samples = documents.filter("is_sample").select("doc_id", F.col("sample_slug").alias("slug"), "status")
    joined = index.join(samples, "slug", "left")
    return joined.withColumn("loaded", F.coalesce(F.col("status") == "embedded", F.lit(False))).drop("status")


def missing_samples(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Index entries not loaded yet: what an idempotent corpus load still has to ingest."""
    present = documents.filter("is_sample").select(F.col("sample_slug").alias("slug"))
    return index.join(present, "slug", "left_anti")


def document_summaries(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Documents with the cost computed on read where loan terms exist."""
    costed = extraction.cost_from_terms(terms).select(
        "doc_id", "cost", F.size("missing").alias("missing_inputs")
    )
    return documents.join(costed, "doc_id", "left")
