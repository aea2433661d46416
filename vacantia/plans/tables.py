"""Canonical tables as versions of Parquet runs behind one manifest each.

A version writes runs of its own, the rows it adds or changes and nothing else, and last of all a manifest that names the
runs of every table as of that version. Readers go through a manifest only, so they never see a version in part: a lost
writer leaves the last whole version in place, and no plan overwrites a path that a manifest names. A version that is
written again does so beside its earlier attempt.

Tables with a key are merged when they are read: of the rows of a key the one of the newest run counts. Runs are merged
by size, so that each is several times as large as all newer ones together: a table of any size has a few runs, and a row
is rewritten a few times in its life, whatever the number of versions. A run is divided into as many buckets as its rows
need, each a range of a fixed number of hash slots, so a look-up reads in every run only the buckets of its keys.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.plans.session import passing, tidy, written

SCHEMAS = {
    "raw_postings": (
        "source_slug string, external_id string, source_url string, apply_url string, company_name string, "
        "company_url string, raw_title string, raw_location string, description string, posted_at timestamp, "
        "remote_type string, employment_type string, salary_min double, salary_max double, "
        "salary_currency string, salary_period string, raw_payload string, checksum string, run_id string, "
        "fetched_at timestamp, ordinal bigint"
    ),
    "status_log": (
        "source_slug string, external_id string, checksum string, status string, error string, "
        "logged_at timestamp, sequence bigint"
    ),
    "captures": (
        "source_slug string, external_id string, checksum string, status string, error string, parser_version int"
    ),
    "jobs": (
        "job_id string, title string, normalized_title string, role_category string, seniority string, "
        "tags array<string>, company_slug string, location_raw string, location_display string, remote_type string, eligible_countries array<string>, "
        "eligible_regions array<string>, geo_confidence string, geo_reason string, employment_type string, "
        "salary_min int, salary_max int, salary_currency string, salary_period string, "
        "technologies array<string>, posted_at timestamp, posted_at_is_inferred boolean, "
        "first_discovered_at timestamp, last_seen_at timestamp, apply_url string, fingerprint string, "
        "is_active boolean"
    ),
    # A job's texts never change, so what changes about a job never carries them along.
    "job_texts": "job_id string, description string, description_text string",
    # What a posting is compared with, by company: the jobs' profiles as resolution reads them.
    "blocks": (
        "company_key string, job_id string, first_discovered_at timestamp, company string, title string, url string, "
        "countries array<string>, regions array<string>, grams array<bigint>"
    ),
    "job_listings": "job_id string, source_slug string, external_id string",
    "listings": (
        "source_slug string, external_id string, job_id string, source_url string, apply_url string, "
        "posted_at timestamp, posted_at_is_inferred boolean, first_discovered_at timestamp, "
        "last_seen_at timestamp, is_active boolean"
    ),
    # What each version adds to the facets' counts.
    "facet_counts": "facet string, value string, count bigint",
    # Landed rows that no mapping could read, with the reason.
    "dead_letters": (
        "source_slug string, board string, page_url string, payload string, run_id string, fetched_at timestamp, error string"
    ),
    # Discovered ids whose details are not known yet.
    "wanted": "source_slug string, external_id string, run_id string, found_at timestamp",
    "companies": "slug string, name string, website_url string",
    "fts_index": "job_id string, term string, positions array<struct<position:int,label:string>>",
    "runs": (
        "run_id string, source_slug string, started_at timestamp, finished_at timestamp, fetched bigint, "
        "eligible bigint, rejected_geography bigint, rejected_role bigint, created bigint, updated bigint, "
        "duplicate bigint, errors bigint, status string, duration_ms bigint, "
        "error_sample array<struct<message:string,external_id:string>>"
    ),
}
# A job with its texts, as resolution reads it where no index of profiles is kept.
WHOLE_JOB = f"{SCHEMAS['jobs']}, description string, description_text string"


def no_rows(spark: SparkSession) -> dict[str, DataFrame]:
    """Empty jobs (with their texts), companies and listings: what a first batch meets."""
    schemas = {"jobs": WHOLE_JOB, "companies": SCHEMAS["companies"], "listings": SCHEMAS["listings"]}
    return {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}


@dataclass(frozen=True)
class Layout:
    """How a table's rows lie: in the order or by the slots of ``by``; the newest row of a ``key`` counts, if it has one."""

    by: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    # In which order rows of the same ``by`` follow, so that many of them need not be one file.
    then: tuple[str, ...] = ()
    # Columns that are added up over the rows of a key, where no single one of them counts.
    added: tuple[str, ...] = ()
    slots: bool = True
    bucket_rows: int = 1 << 18


_LISTING = ("source_slug", "external_id")
LAYOUTS = {
    "raw_postings": Layout(("source_slug",), slots=False),
    "status_log": Layout(slots=False),
    "runs": Layout(slots=False),
    # Terms in order, so that a query's words are found by the files' own statistics.
    "fts_index": Layout(("term", "job_id"), slots=False),
    "facet_counts": Layout(key=("facet", "value"), added=("count",), slots=False),
    "dead_letters": Layout(slots=False),
    "wanted": Layout(slots=False),
    "captures": Layout(_LISTING, (*_LISTING, "checksum"), ("checksum",)),
    "listings": Layout(_LISTING, _LISTING),
    "jobs": Layout(("job_id",), ("job_id",)),
    "companies": Layout(("slug",), ("slug",)),
    "job_texts": Layout(("job_id",), bucket_rows=1 << 15),
    "blocks": Layout(("company_key",), then=("first_discovered_at", "job_id"), bucket_rows=1 << 15),
    "job_listings": Layout(("job_id",), then=_LISTING),
}
# Ranges of these make buckets, so a run may have as many buckets and a look-up brings as many numbers to the driver.
SLOTS = 1 << 16
# A run is at least so many times as large as all newer runs together.
RATIO = 4
# Keys up to this number go to all tasks of a join; more never do, whatever the size of their files says.
FEW_KEYS = 100_000
SLOT = "_slot"


def _met(keys: DataFrame, rows: int) -> DataFrame:
    """Keys as the side that a join asks. Their number, not their files, says whether they are few enough to broadcast.

    A file of one column of a wide or repetitive table says little of what its rows take in the driver.
    """
    return F.broadcast(keys) if rows <= FEW_KEYS else keys.hint("merge")


class Tables:
    """Read and write the tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # --- manifests ---

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _published(self) -> list[tuple[int, int]]:
        """Whole versions with their attempts, oldest first."""
        found = [n.removesuffix(".json").split(".") for n in self._names("manifests") if n.endswith(".json") and n[0] != "_"]
        return sorted((int(version), int(attempt)) for version, attempt in found)

    def versions(self) -> list[int]:
        """Whole versions, oldest first."""
        return sorted({version for version, _ in self._published()})

    def manifest(self, before: int | None = None) -> dict[str, list[dict]]:
        """The runs of every table, oldest first, as of the last version (before the given number) and its last attempt."""
        wanted = [p for p in self._published() if before is None or p[0] < before]
        return self._manifest(*wanted[-1]) if wanted else {}

    def _manifest(self, version: int, attempt: int) -> dict[str, list[dict]]:
        text = self.spark.read.option("wholetext", True).text(f"{self.root}/manifests/{version}.{attempt}.json").first()[0]
        return json.loads(text)

    def _folder(self, name: str, version: int) -> str:
        """Where a version's rows of a table go: not where those of an attempt are that was published."""
        attempt = sum(v == version for v, _ in self._published())
        return f"{name}/v={version}.{attempt}"

    def publish(self, version: int, runs: dict[str, dict]) -> None:
        """Make a version whole: its new runs on top of those before it, merged where they have grown alike."""
        manifest = self.manifest(version)
        for name, run in runs.items():
            manifest[name] = self._merged(name, [*manifest.get(name, []), *([run] if run["rows"] else [])], version)
        # Written beside and renamed under a name of its own, so a manifest is there as a whole or not at all, and the one of
        # an earlier attempt stays until readers see this one.
        attempt = sum(v == version for v, _ in self._published())
        fs, beside = self._path(f"manifests/_{version}.{attempt}.json")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, path = self._path(f"manifests/{version}.{attempt}.json")
        if not fs.rename(beside, path):
            raise OSError(f"manifest {version} could not be put in place")

    def _merged(self, name: str, runs: list[dict], version: int) -> list[dict]:
        """Merge the newest runs as long as the one before them is not much larger than they are together."""
        first, rows = len(runs) - 1, runs[-1]["rows"] if runs else 0
        while first > 0 and runs[first - 1]["rows"] < RATIO * rows:
            first -= 1
            rows += runs[first]["rows"]
        if first >= len(runs) - 1:
            return runs
        return [*runs[:first], self._write(name, self._rows(name, runs[first:]), f"{self._folder(name, version)}-merged")]

    def vacuum(self, keep: int) -> list[str]:
        """Delete the runs that none of the last ``keep`` versions reads, and their manifests; gives what went.

        Runs of versions above the last whole one may be in the making and stay.
        """
        published = self._published()
        kept = set(self.versions()[-keep:])
        read = {run["folder"] for p in published if p[0] in kept for runs in self._manifest(*p).values() for run in runs}
        gone = [f"manifests/{v}.{a}.json" for v, a in published if v not in kept]
        for name in LAYOUTS:
            for folder in self._names(name):
                version = int(folder.removeprefix("v=").split(".")[0])
                if f"{name}/{folder}" not in read and version <= max(kept, default=-1):
                    gone.append(f"{name}/{folder}")
        # Manifests first: none may name a run that is gone.
        for path in gone:
            fs, at = self._path(path)
            fs.delete(at, True)
        return gone

    # --- reading ---

    def slot_of(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in LAYOUTS[name].by]), F.lit(SLOTS)).cast("int")

    def slots(self, name: str, keys: DataFrame) -> dict[int, int]:
        """The slots of some keys, and the number of rows in each: at most ``SLOTS`` of them."""
        found = keys.groupBy(self.slot_of(name).alias(SLOT)).agg(F.count("*").alias("rows")).collect()
        return {r[SLOT]: r["rows"] for r in sorted(found)}

    def _paths(self, run: dict, slots: list[int] | None) -> list[str]:
        """A run's folder, or the folders of the buckets that hold some slots."""
        if slots is None or run["buckets"] < 2:
            return [f"{self.root}/{run['folder']}"]
        wanted = {slot * run["buckets"] // SLOTS for slot in slots} - set(run["empty"])
        return [f"{self.root}/{run['folder']}/bucket={b}" for b in sorted(wanted)]

    def _rows(self, name: str, runs: list[dict], slots: list[int] | None = None) -> DataFrame:
        """The rows of some runs, oldest first; of a key the newest row."""
        schema, key = SCHEMAS[name], list(LAYOUTS[name].key)
        if LAYOUTS[name].slots:
            schema += f", {SLOT} int"
        columns = [f.split()[0] for f in _fields(schema)]

        def read(run: dict) -> DataFrame:
            paths = self._paths(run, slots)
            if not paths:
                return self.spark.createDataFrame([], schema)
            # Without the folders' own column, the bucket.
            return self.spark.read.schema(schema).parquet(*paths).select(*columns)

        if LAYOUTS[name].added:
            every = reduce(DataFrame.unionByName, map(read, runs))
            return every.groupBy(*key).agg(*[F.sum(c).alias(c) for c in LAYOUTS[name].added])
        if not key or len(runs) < 2:
            return reduce(DataFrame.unionByName, map(read, runs))
        newer = reduce(DataFrame.unionByName, [read(run).withColumn("_run", F.lit(i)) for i, run in enumerate(runs[1:])])
        rows = sum(run["rows"] for run in runs[1:])
        if len(runs) > 2:
            # Only keys and ranks of what is much smaller than the oldest run are aggregated.
            last = newer.groupBy(*key).agg(F.max("_run").alias("_run"))
            newer = newer.join(_met(last, rows), [*key, "_run"], "left_semi")
        newer = newer.drop("_run")
        older = read(runs[0]).join(_met(newer.select(*key).distinct(), rows), key, "left_anti")
        return older.unionByName(newer)

    def read(self, name: str, before: int | None = None, slots: list[int] | None = None) -> DataFrame:
        """The table as of the last whole version (before the given number); at least the rows in ``slots``, if given."""
        runs = self.manifest(before).get(name, [])
        columns = [f.split()[0] for f in _fields(SCHEMAS[name])]
        if not runs or slots == []:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self._rows(name, runs, slots).select(*columns)

    def rows_of(self, name: str, run: dict) -> DataFrame:
        """The rows that a version wrote."""
        return self._rows(name, [run]).select(*[f.split()[0] for f in _fields(SCHEMAS[name])])

    def lookup(self, name: str, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The rows whose ``by`` columns are among those of ``keys``, from the buckets that can hold them."""
        by, slots = list(LAYOUTS[name].by), self.slots(name, keys)
        wanted = _met(keys.select(*by).distinct(), sum(slots.values()))
        return self.read(name, before, list(slots)).join(wanted, by, "left_semi")

    # --- writing ---

    def write(self, name: str, frame: DataFrame, version: int) -> dict:
        """Write the rows a version adds or changes as a run, for ``publish``; the same version again writes beside it."""
        columns = [f"CAST({c.split()[0]} AS {' '.join(c.split()[1:])}) AS {c.split()[0]}" for c in _fields(SCHEMAS[name])]
        return self._write(name, frame.selectExpr(*columns), self._folder(name, version))

    def _write(self, name: str, rows: DataFrame, folder: str) -> dict:
        # The rows as they come lie beside the run only until it is written.
        with passing(self.spark), tidy(rows.sparkSession):
            return self._written(name, rows, folder)

    def _written(self, name: str, rows: DataFrame, folder: str) -> dict:
        layout, path = LAYOUTS[name], f"{self.root}/{folder}"
        if not layout.slots:
            if name == "raw_postings":
                rows.write.mode("overwrite").partitionBy(*layout.by).parquet(path)
            elif layout.by:
                rows.repartitionByRange(*layout.by).sortWithinPartitions(*layout.by).write.mode("overwrite").parquet(path)
            else:
                rows.write.mode("overwrite").parquet(path)
            count = self.spark.read.schema(SCHEMAS[name]).parquet(path).count()
            return {"folder": folder, "rows": count, "buckets": 0}
        # Written as they come first: their number says into how many buckets they go.
        rows = written(rows.withColumn(SLOT, self.slot_of(name)))
        count = rows.count()
        buckets = 1
        while buckets < SLOTS and buckets * layout.bucket_rows < count:
            buckets *= 2
        order = [SLOT, *layout.by, *layout.then]
        if buckets == 1:
            rows.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
        else:
            # By ranges of all that orders the rows, so a key with many of them is several files of its bucket.
            dealt = rows.repartitionByRange(buckets, *order).sortWithinPartitions(*order)
            dealt.withColumn("bucket", self._bucket(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)
        there = {n.removeprefix("bucket=") for n in self._names(folder)}
        empty = [b for b in range(buckets) if str(b) not in there] if buckets > 1 else []
        run = {"folder": folder, "rows": count, "buckets": buckets, "empty": empty}
        if name == "listings":
            run["seen"] = self._seen(rows, buckets)
        return run

    def _bucket(self, buckets: int) -> Column:
        return F.expr(f"CAST({SLOT} * {buckets}L DIV {SLOTS} AS int)")

    # --- what a sweep may skip ---

    def _seen(self, listings: DataFrame, buckets: int) -> dict[str, dict[str, int]]:
        """By source and bucket when an active listing of a run was last seen, at the earliest (microseconds)."""
        least = listings.where("is_active").groupBy("source_slug", self._bucket(buckets).alias("bucket")).agg(
            F.min(F.unix_micros("last_seen_at")).alias("least")
        )
        seen: dict[str, dict[str, int]] = {}
        for row in least.where("source_slug IS NOT NULL AND least IS NOT NULL").collect():
            seen.setdefault(row["source_slug"], {})[str(row["bucket"])] = row["least"]
        return seen

    def unseen_slots(self, since: dict[str, int], before: int | None = None) -> list[int]:
        """The slots that can hold an active listing of a source last seen before a time (microseconds)."""
        found: set[int] = set()
        for run in self.manifest(before).get("listings", []):
            width = SLOTS // run["buckets"]
            for source, time in since.items():
                for bucket, least in run["seen"].get(source, {}).items():
                    if least < time:
                        found.update(range(int(bucket) * width, (int(bucket) + 1) * width))
        return sorted(found)


def _fields(schema: str) -> list[str]:
    """Split a schema text at its outer commas."""
    out, depth, field = [], 0, ""
    for char in schema:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            out.append(field.strip())
            field = ""
        else:
            field += char
    return [*out, field.strip()]
