"""Writers: snapshots flipped at once, objects by content, idempotent batches, books and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import clock


class Snapshots:
    """A table of immutable snapshots under ``root``; readers pin one, a writer adds the next.

    Data is written to its own folder first; then the pointer is renamed into place with
    the file system of the path, so a reader sees the old or the new snapshot, never part of one.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def ids(self) -> list[int]:
        """Ids of the committed snapshots, in order."""
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def read(self, snapshot: int | None = None) -> DataFrame:
        """The given snapshot, or the newest."""
        ids = self.ids()
        at = snapshot if snapshot is not None else (ids[-1] if ids else None)
        if at not in ids:
            raise LookupError("no such snapshot")
        return self.spark.read.parquet(f"{self.root}/data/{at}")

    def commit(self, df: DataFrame, expected: int | None = None) -> int:
        """Write the next snapshot; with ``expected`` only if that is still the newest. Returns its id."""
        ids = self.ids()
        newest = ids[-1] if ids else 0
        if expected is not None and expected != newest:
            raise RuntimeError(f"snapshot {newest} was committed meanwhile")
        following = newest + 1
        df.write.mode("overwrite").parquet(f"{self.root}/data/{following}")
        waiting, final = self._path(f"{self.root}/_waiting/{following}"), self._path(f"{self.root}/_commits/{following}")
        self._fs.mkdirs(self._path(f"{self.root}/_commits"))
        self._fs.create(waiting, True).close()
        if self._fs.exists(final) or not self._fs.rename(waiting, final):
            raise RuntimeError(f"snapshot {following} was committed meanwhile")
        return following


def store_objects(objects: DataFrame, content: str, root: str, known: DataFrame | None = None) -> DataFrame:
    """Write each distinct content once, partitioned by the first two digits of its hash; (sha256, size) of what was written.

    ``known`` (sha256) are objects that are there already.
    """
    rows = objects.filter(F.col(content).isNotNull()).withColumn("sha256", F.sha2(F.col(content), 256)).withColumn("size", F.octet_length(content)).dropDuplicates(["sha256"])
    if known is not None:
        rows = rows.join(known.select("sha256"), "sha256", "left_anti")
    rows.select(F.left("sha256", F.lit(2)).alias("shard"), "sha256", "size", F.col(content).alias("content")).write.mode("append").partitionBy("shard").parquet(root)
    return rows.select("sha256", "size")


def once(batch: DataFrame, applied: DataFrame, digest: list[str]) -> DataFrame:
    """Rows of a batch whose request digest has not been applied; repeats inside the batch count once."""
    marked = batch.withColumn("digest", F.sha2(F.to_json(F.struct(*digest), {"ignoreNullFields": "false"}), 256)).dropDuplicates(["digest"])
    return marked.join(applied.select("digest").distinct(), "digest", "left_anti")


def replay_outcome(requests: DataFrame, current: DataFrame) -> DataFrame:
    """(digest, outcome) of pending requests (digest, path, before, after) against the pages as they are.

    applied: every page is as after; reverted: every page is as before; partial otherwise.
    """
    rows = requests.join(current.select("path", F.col("text").alias("_now")), "path", "left")
    seen = rows.groupBy("digest").agg(F.bool_and(F.col("_now").eqNullSafe(F.col("after"))).alias("a"), F.bool_and(F.col("_now").eqNullSafe(F.col("before"))).alias("b"))
    return seen.select("digest", F.when(F.col("a"), "applied").when(F.col("b"), "reverted").otherwise("partial").alias("outcome"))


def chapters_of(pages: DataFrame, book: str, page: str, title: str) -> DataFrame:
    """(book, chapter_no, title, first_page, last_page): a page with a title begins a chapter; pages before are a chapter without one."""
    from pyspark.sql import Window as W

    w = W.partitionBy(book).orderBy(page)
    rows = pages.withColumn("_new", F.col(title).isNotNull().cast("int")).withColumn("chapter_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(book, "chapter_no").agg(F.max(title).alias("title"), F.min(page).alias("first_page"), F.max(page).alias("last_page"))


def book_files(pages: DataFrame, book: str, page: str, text: str, chapter: str, split_over: int = 256 * 1024) -> DataFrame:
    """(book, file, bytes, text): one file per book, or one per chapter and an index where it is over ``split_over`` bytes and has two chapters or more."""
    cells = F.array_sort(F.collect_list(F.struct(page, F.col(text).alias("_t"))))
    per = pages.filter(F.col(text).isNotNull()).groupBy(book, chapter).agg(F.array_join(F.transform(cells, lambda c: c["_t"]), "\n\n").alias("text"))
    per = per.withColumn("bytes", F.octet_length("text"))
    size = per.groupBy(book).agg(F.sum("bytes").alias("_all"), F.count("*").alias("_n"))
    rows = per.join(size, book)
    split = (F.col("_all") > split_over) & (F.col("_n") >= 2)
    parts = rows.filter(split).select(book, F.format_string("chapter-%03d.md", F.col(chapter).cast("int")).alias("file"), "bytes", "text")
    chapters = F.array_sort(F.collect_list(F.struct(chapter, F.format_string("chapter-%03d.md", F.col(chapter).cast("int")).alias("_f"))))
    index = rows.filter(split).groupBy(book).agg(F.array_join(F.transform(chapters, lambda c: F.concat(F.lit("- ["), c["_f"], F.lit("]("), c["_f"], F.lit(")"))), "\n").alias("text")).select(book, F.lit("index.md").alias("file"), F.octet_length("text").alias("bytes"), "text")
    bodies = F.array_sort(F.collect_list(F.struct(chapter, F.col("text").alias("_t"))))
    whole = rows.filter(~split).groupBy(book).agg(F.array_join(F.transform(bodies, lambda c: c["_t"]), "\n\n").alias("text")).select(book, F.lit("book.md").alias("file"), F.octet_length("text").alias("bytes"), "text")
    return parts.unionByName(index).unionByName(whole)


def transcript_lines(runs: DataFrame, by: list[str], speaker: str, start: str, text: str) -> DataFrame:
    """(by, transcript): one line ``**speaker** [clock] text`` per run, in time order."""
    line = F.concat(F.lit("**"), F.coalesce(F.col(speaker).cast("string"), F.lit("Unknown")), F.lit("** ["), clock(start), F.lit("] "), F.col(text))
    cells = F.array_sort(F.collect_list(F.struct(F.col(start).alias("_s"), line.alias("_l"))))
    return runs.filter(F.col(text).isNotNull()).groupBy(*by).agg(F.array_join(F.transform(cells, lambda c: c["_l"]), "\n\n").alias("transcript"))


def frontmatter_text(fields: list[tuple[str, str]]):
    """A column with the ``---`` block of the given (name, column) fields, empty ones left out."""
    lines = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{n}: "), F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6))) for n, c in fields]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"))


def voiceprint_lines(profiles: DataFrame, by: str) -> DataFrame:
    """(line): one JSON line per profile with its name, number of samples and unit vector, for a text writer."""
    return profiles.select(F.to_json(F.struct(F.col(by), F.col("n_all").alias("samples"), F.col("centroid").alias("vector"))).alias("line"))


def published(pages: DataFrame, assets: DataFrame, path: str, text: str) -> DataFrame:
    """(path, kind): what a publication holds: every page, and of the assets (path) only those some page names."""
    from foliospark.operators.relations import referenced

    return pages.select(F.col(path).alias("path"), F.lit("page").alias("kind")).unionByName(referenced(assets, pages, text).select("path", F.lit("asset").alias("kind")))
