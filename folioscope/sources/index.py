"""The index: a Parquet table of points with a ledger of ingested files.

Layout below ``path``::

    properties/            one row: collection, vector size, metric
    manifest/ingest=N/     files chosen for ingest N
    points/ingest=N/       the data files that commit N added
    entries/ingest=N/      their payload index: which data file has which value, and its range of ids
    removed/ingest=N/      data files that commit N replaced
    files/ingest=N/        ledger: one row per file
    commits/ingest=N/      one row, written last

A commit counts once its row is written.  Until then readers skip what it wrote, and a rerun takes
the same number and overwrites it, so a job that died half-way leaves neither duplicates nor gaps.
A reader of an earlier commit sees the data files of that time, as none is ever changed: an upsert
copies those that hold replaced points.  One writer at a time is assumed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.functions.payload import matches_all
from folioscope.functions.vectors import checked_size
from folioscope.operators.chunking import chunk_lengths
from folioscope.schemas import PAYLOAD, POINT, VECTOR
from folioscope.session import stored

#: Distinct files per row group that the Bloom filters are sized for: about the number
#: of chunks of full length that a row group of 128 MB holds.
ROW_GROUP_FILES = 10_000

MANIFEST_SCHEMA = "path string, file_name string, file_hash string"
PROPERTIES_SCHEMA = "collection string, vector_size int, metric string"
COMMIT_SCHEMA = "kind string, ingest int"
#: ``n`` points of a data file have ``value`` in ``field``; their ids lie within the range.  The rows of
#: ``ALL_POINTS`` tell the same of a file's points altogether.
ENTRY_SCHEMA = "field string, value string, file string, n long, first_id string, last_id string, ingest int"
REMOVED_SCHEMA = "file string, ingest int"
ALL_POINTS = "*"
LEDGER_SCHEMA = (
    "file_hash string, file_name string, path string, n_chunks long, min_length int, "
    "max_length int, median_length int, ingest int"
)
POINTS_SCHEMA = f"id string, vector {VECTOR.simpleString()}, payload {PAYLOAD.simpleString()}, ingest int"


@dataclass(frozen=True)
class Collection:
    spark: SparkSession
    path: str
    name: str = C.DEFAULT_COLLECTION
    vector_size: int = C.VECTOR_SIZE

    def _table(self, table: str) -> str:
        return f"{self.path.rstrip('/')}/{self.name}/{table}"

    def _read(self, table: str, schema: str) -> DataFrame:
        """The table, or no rows where nothing has been written yet."""
        try:
            return self.spark.read.schema(schema).parquet(self._table(table))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def properties(self) -> DataFrame:
        """One row, or none where the collection was never completely created."""
        return self._read("properties", PROPERTIES_SCHEMA)

    def exists(self) -> bool:
        return not self.properties().isEmpty()

    def require(self) -> Collection:
        declared = self.properties().first()
        if declared is None:
            raise ValueError(f"Collection '{self.name}' does not exist in {self.path}")
        if declared["vector_size"] != self.vector_size:
            raise ValueError(
                f"Collection '{self.name}' has vectors of size {declared['vector_size']}, not {self.vector_size}"
            )
        return self

    def create_if_absent(self) -> Collection:
        if self.exists():
            return self.require()
        self.spark.range(1, numPartitions=1).select(
            F.lit(self.name).alias("collection"),
            F.lit(self.vector_size).alias("vector_size"),
            F.lit(C.VECTOR_METRIC).alias("metric"),
        ).write.mode("overwrite").parquet(self._table("properties"))
        return self

    def commits(self) -> dict[int, str]:
        """The numbers of all commits, and what each was."""
        rows = self._read("commits", COMMIT_SCHEMA).collect()
        return {row["ingest"]: row["kind"] or "ingest" for row in rows}

    def last_ingest(self) -> int:
        return max(self.commits(), default=0)

    def files(self) -> DataFrame:
        """The ledger: every file of a finished ingest, also those without any text."""
        ingests = [n for n, kind in self.commits().items() if kind == "ingest"]
        return self._read("files", LEDGER_SCHEMA).where(F.col("ingest").isin(ingests))

    def _live(self, table: str, schema: str, file: Column, version: int | None, commits: dict[int, str] | None = None) -> DataFrame:
        """Rows of a table of data files as of a commit; later and unfinished ones are pruned as
        partitions, and replaced files by their names."""
        commits = self.commits() if commits is None else commits
        version = max(commits, default=0) if version is None else version
        seen = [n for n in commits if n <= version]
        rows = self._read(table, schema).where(F.col("ingest").isin(seen))
        rewrites = [n for n in seen if commits[n] == "upsert"]
        if not rewrites:
            return rows
        removed = self._read("removed", REMOVED_SCHEMA).where(F.col("ingest").isin(rewrites))
        return rows.where(~file.isin([row["file"] for row in removed.select("file").collect()]))

    def points(self, version: int | None = None) -> DataFrame:
        """``(id, vector, payload)`` of every point, as of the latest or an earlier commit."""
        return self._live("points", POINTS_SCHEMA, F.col("_metadata.file_name"), version).drop("ingest")

    def located_points(self, version: int | None = None) -> DataFrame:
        """Points with ``_file``, the data file that holds each."""
        commits, name = self.commits(), F.col("_metadata.file_name")
        if not commits:
            return self.points(version).withColumn("_file", F.lit(""))
        rows = self._live("points", POINTS_SCHEMA, name, version, commits)
        return rows.select("id", "vector", "payload", F.concat(F.lit("ingest="), "ingest", F.lit("/"), name).alias("_file"))

    def points_in(self, files: DataFrame) -> DataFrame:
        """The points of the data files named in ``_file``; no other file is opened."""
        return self._of_files([row["_file"] for row in files.select("_file").distinct().collect()])

    def _of_files(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], POINT)
        return self.spark.read.schema(POINT).parquet(*(f"{self._table('points')}/{name}" for name in sorted(names)))

    def entries(self, version: int | None = None) -> DataFrame:
        """The payload index of the live data files."""
        return self._live("entries", ENTRY_SCHEMA, F.col("file"), version)

    def files_with(self, terms: dict[str, str] | None = None, version: int | None = None) -> DataFrame:
        """``(_file, n, first_id, last_id)`` of the data files that may hold points with all ``terms``.

        The file sets of the terms are intersected; ``n`` is the most points that a file can have, and
        exact for one term or none.
        """
        wanted = list((terms or {ALL_POINTS: ""}).items())
        unknown = set(terms or {}) - set(C.KEYWORD_FIELDS)
        if unknown:
            raise ValueError(f"no payload index on {sorted(unknown)}")
        either = reduce(Column.__or__, ((F.col("field") == f) & (F.col("value") == v) for f, v in wanted))
        file = F.concat_ws("/", F.concat(F.lit("ingest="), "ingest"), "file").alias("_file")
        found = self.entries(version).where(either).groupBy(file)
        met = found.agg(F.count(F.lit(1)).alias("_terms"), F.min("n").alias("n"), F.max("first_id").alias("first_id"), F.min("last_id").alias("last_id"))
        return met.where(F.col("_terms") == len(wanted)).drop("_terms")

    def has(self, terms: dict[str, str], version: int | None = None) -> bool:
        """Whether any point has all ``terms``; one term is answered by the payload index alone."""
        files = self.files_with(terms, version)
        if len(terms) == 1:
            return not files.isEmpty()
        return not self.points_in(files).where(matches_all(F.col("payload"), terms)).isEmpty()

    def scroll(
        self, terms: dict[str, str] | None = None, limit: int = 10, after: str | None = None, version: int | None = None
    ) -> DataFrame:
        """The first ``limit`` points by id, behind the id ``after``, that match all keyword ``terms``.

        The payload index tells the files to look at.  Ids and keywords of these give the last id of the
        page and the files that hold it, and only their points of that range are read in whole.
        """
        files = self.files_with(terms, version).collect()
        if after is not None:
            files = [f for f in files if f["last_id"] > after]
        if len(terms or {}) <= 1:
            # Behind the last id of files that hold enough points between them, no file need be opened.
            enough, end = 0, None
            for file in sorted(files, key=lambda f: f["last_id"]):
                enough += file["n"] if after is None or file["first_id"] > after else 0
                if enough >= limit:
                    end = file["last_id"]
                    break
            files = [f for f in files if end is None or f["first_id"] <= end]
        matching = matches_all(F.col("payload"), terms or {})
        if after is not None:
            matching = matching & (F.col("id") > after)
        names = [f["_file"] for f in files]
        if not names:
            return self._of_files([])
        name = F.concat(F.lit("ingest="), F.regexp_extract("_metadata.file_path", "ingest=([0-9]+)/[^/]*$", 1), F.lit("/"), F.col("_metadata.file_name"))
        page = self._of_files(names).where(matching).select("id", name.alias("_file")).orderBy("id").limit(limit)
        found = page.agg(F.max("id").alias("last"), F.collect_set("_file").alias("files")).first()
        within = matching & (F.col("id") <= F.lit(found["last"]))
        return self._of_files(found["files"]).where(within).orderBy("id").limit(limit)

    def pages(self, size: int, version: int | None = None) -> DataFrame:
        """``(page, first_id, last_id, n)`` of all pages of ``size`` points in order of ids, so that readers
        can scroll any page: it starts behind the last id of the one before.

        Ids are sorted by range and counted per part, so no task sees them all.
        """
        ids = self.points(version).select("id").repartitionByRange("id").sortWithinPartitions("id")
        placed = stored(ids.withColumn("_place", F.monotonically_increasing_id()), "pages")
        part = F.shiftright("_place", 33)
        counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
        # One row per part.
        starts = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
        at = F.col("_before") + F.col("_place") - F.col("_first")
        numbered = placed.join(starts, part == F.col("_part")).select("id", F.call_function("div", at, F.lit(size)).alias("page"))
        return numbered.groupBy("page").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n"))

    def contains_file(self, file_hash: str) -> bool:
        return not self.files().where(F.col("file_hash") == file_hash).limit(1).isEmpty()

    def stage_manifest(self, new: DataFrame, ingest: int) -> DataFrame:
        """Write the files chosen for an ingest, so that every later step sees the same ones."""
        target = f"{self._table('manifest')}/ingest={ingest}"
        new.select("path", "file_name", "file_hash").write.mode("overwrite").parquet(target)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(target)

    def write_points(self, points: DataFrame, ingest: int) -> DataFrame:
        """Write the points of an ingest and return their file hashes and text lengths.

        The lengths are a column of their own, so that statistics need not read texts.
        Bloom filters and dictionaries on the keyword fields, and the order by file
        within each output file, let a keyword filter skip row groups.
        """
        target = f"{self._table('points')}/ingest={ingest}"
        writer = (
            points.select(
                "id",
                checked_size(F.col("vector"), self.vector_size).alias("vector"),
                "payload",
                F.length("payload.text").alias("n_chars"),
            )
            .sortWithinPartitions("payload.file_hash", "id")
            .write.mode("overwrite")
        )
        for field in C.KEYWORD_FIELDS:
            writer = writer.option(f"parquet.bloom.filter.enabled#payload.{field}", "true").option(
                f"parquet.bloom.filter.expected.ndv#payload.{field}", str(ROW_GROUP_FILES)
            )
        writer.parquet(target)
        return self.spark.read.parquet(target).select("payload.file_hash", "n_chars")

    def finish(self, manifest: DataFrame, written: DataFrame, ingest: int) -> DataFrame:
        """Write the ledger, with the chunk statistics of every file, commit, and return the ledger."""
        target = f"{self._table('files')}/ingest={ingest}"
        stats = chunk_lengths(written, "file_hash", length=F.col("n_chars"))
        (
            manifest.join(stats, "file_hash", "left")
            .withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long")))
            .select("file_hash", "file_name", "path", "n_chunks", "min_length", "max_length", "median_length")
            .write.mode("overwrite")
            .parquet(target)
        )
        self._write_entries(ingest)
        self._commit(ingest, "ingest")
        return self.spark.read.parquet(target)

    def _write_entries(self, ingest: int) -> None:
        """Write the payload index of the data files of a commit."""
        points = self.spark.read.schema(POINT).parquet(f"{self._table('points')}/ingest={ingest}")
        every = F.struct(F.lit(ALL_POINTS).alias("field"), F.lit("").alias("value"))
        fields = (F.struct(F.lit(f).alias("field"), F.col(f"payload.{f}").alias("value")) for f in C.KEYWORD_FIELDS)
        held = points.select("id", F.col("_metadata.file_name").alias("file"), F.inline(F.array(every, *fields)))
        entries = held.where(F.col("value").isNotNull()).groupBy("field", "value", "file")
        found = entries.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        # In order, so that a lookup skips row groups and pages.
        found.sortWithinPartitions("field", "value").write.mode("overwrite").parquet(f"{self._table('entries')}/ingest={ingest}")

    def _commit(self, ingest: int, kind: str) -> None:
        row = self.spark.range(1, numPartitions=1).select(F.lit(kind).alias("kind"))
        row.write.mode("overwrite").parquet(f"{self._table('commits')}/ingest={ingest}")

    def upsert(self, points: DataFrame, version: Column | None = None) -> int:
        """Write points ``(id, vector, payload)``, in place of those with the same ids; returns the commit.

        Of incoming points with one id the latest counts, as in ``keep_latest``.  Data files that hold
        replaced points are copied without these, all others stay as they are, and readers of earlier
        commits go on seeing the old files.
        """
        self.require()
        commits = self.commits()
        number = max(commits, default=0) + 1
        latest = stored(latest_rows(points, "id", version).select("id", "vector", "payload"), "upsert")
        touched = self.located_points().select("id", "_file").join(latest.select("id"), "id", "left_semi")
        names = [row["_file"] for row in touched.select("_file").distinct().collect()]
        # By ranges of ids, so that the files to copy next time, or to scroll, are few.  All rows of an id
        # come together there, so the replaced ones are found without moving the points for a join.
        both = self._of_files(names).withColumn("_new", F.lit(0)).unionByName(latest.withColumn("_new", F.lit(1)))
        ranged = both.repartitionByRange("id").withColumn("_newest", F.max("_new").over(Window.partitionBy("id")))
        # An id that is null replaces none.
        stays = F.col("id").isNull() | (F.col("_new") == F.col("_newest"))
        self.write_points(ranged.where(stays).drop("_new", "_newest"), number)
        gone = self.spark.createDataFrame([(name.split("/")[-1],) for name in names], "file string")
        gone.coalesce(1).write.mode("overwrite").parquet(f"{self._table('removed')}/ingest={number}")
        self._write_entries(number)
        self._commit(number, "upsert")
        return number


def latest_rows(incoming: DataFrame, key: str = "id", version: Column | None = None) -> DataFrame:
    """One row per key: that with the largest ``version``, or without one the largest row by its columns."""
    row = F.struct(*incoming.columns)
    # The largest struct rather than ``max_by``, which would carry the row twice.
    if version is None:
        best, row = F.max(row), "_row.*"
    else:
        best, row = F.max(F.struct(version.alias("version"), row.alias("row"))), "_row.row.*"
    return incoming.groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select(row)


def keep_latest(
    existing: DataFrame, incoming: DataFrame, key: str = "id", version: Column | None = None
) -> DataFrame:
    """Upsert: incoming rows replace existing ones with the same key.

    Of incoming rows with one key, the one with the largest ``version`` stays (without a version, the
    largest row by its columns in order), whatever the order in which they arrive.
    """
    latest = latest_rows(incoming, key, version)
    return existing.join(latest.select(key), key, "left_anti").unionByName(latest)


def collection_report(points: DataFrame) -> DataFrame:
    """Point count, as a number and with thousands separators."""
    return points.agg(F.count(F.lit(1)).alias("points_count")).withColumn(
        "points_label", F.format_number("points_count", 0)
    )


def sample_files(points: DataFrame, file_name: str = "payload.file_name", order: str = "id") -> DataFrame:
    """Distinct file names of the first 10 points: five of them, and how many more."""
    names = (
        points.select(F.col(order).alias("_order"), F.col(file_name).alias("_name"))
        .orderBy("_order")
        .limit(C.SAMPLE_POINTS)
        .agg(F.sort_array(F.collect_set("_name")).alias("_names"))
    )
    return names.select(
        F.array_join(F.slice("_names", 1, C.SAMPLE_FILES), ", ").alias("sample"),
        F.greatest(F.size("_names") - C.SAMPLE_FILES, F.lit(0)).alias("n_more"),
    )


def collection_status(collection: Collection | None) -> str | DataFrame:
    """What a user sees about the connection: a message, or counts and sample file names."""
    if collection is None:
        return C.NO_CONNECTION
    if not collection.exists():
        return C.NO_COLLECTION.format(name=collection.name)
    points = collection.points()
    # Both sides have one row.
    return (
        collection_report(points)
        .withColumn("collection", F.lit(collection.name))
        .join(sample_files(points).withColumn("collection", F.lit(collection.name)), "collection")
    )
