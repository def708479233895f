"""Line-level duplicate removal with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, discard, free_stem, join_skewed, materialise, parallel_tasks, read_table, scratch_root, text_of

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
#: Runs of one level that are merged into one run of the next.
FAN_IN = 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


@contextmanager
def sorted_buckets(spark: SparkSession):
    """Let scans of bucketed tables say that each bucket, being one file, is sorted; joins then merge without a sort."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, keeper, first_seen) by level, as bucketed tables in the shared folder.

    A batch holds rows (h1, h2, id), one for each document and line key, and batches come in falling order of id. Each
    is first merge-anti-joined with every run: a key that they lack is new, and the batch's largest id with it keeps it.
    Then the batch adds its own run: new keys with their keeper, known keys with a count alone. Once a level has
    ``fan_in`` runs they are compacted into one of the next level, so a key is rewritten at most log(batches) times.
    Runs are bucketed by hash and sorted within buckets, one file each: a join with a run, or of two, neither shuffles
    nor sorts it. Only a batch is shuffled, once, after its keys are counted where they lie.
    """

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN) -> None:
        self.spark, self.fan_in = spark, fan_in
        self.buckets = parallel_tasks(spark)
        self.levels: list[list[DataFrame]] = []

    def _sorted(self, run: DataFrame, level: int) -> DataFrame:
        name = f"xeric_line_run_{level}_{uuid.uuid4().hex}"
        path = f"{scratch_root(self.spark)}/xeric/{name}"
        # Rows lie by hash(h1, h2) already, as they come from a count or a join by them, so each bucket is in one task.
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out._scratch_path, out._scratch_name = path, name
        return out

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def drop(self, runs: list[DataFrame]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run._scratch_name}")
        discard(*runs)

    def add(self, batch: DataFrame) -> None:
        own = batch.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            keys = run.filter("first_seen").select("h1", "h2", F.lit(True).alias(f"known_{i}"))
            own = own.join(keys.hint("merge"), ["h1", "h2"], "left")
            known = known | F.col(f"known_{i}").isNotNull()
        own = own.select("h1", "h2", "n_docs", F.when(~known, F.col("keeper")).alias("keeper"), (~known).alias("first_seen"))
        with sorted_buckets(self.spark):
            self._place(self._sorted(own, 0), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_in:
            old, self.levels[level] = self.levels[level], []
            merged = self._sorted(self._merge(old), level + 1)
            self.drop(old)
            self._place(merged, level + 1)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select("h1", "h2", *[F.col(c).alias(f"_{c}") for c in ("n_docs", "keeper", "first_seen")])
            both = a.join(b.hint("merge"), ["h1", "h2"], "full")
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n_docs", F.lit(0))
            seen = F.coalesce("first_seen", F.lit(False)) | F.coalesce("_first_seen", F.lit(False))
            # A key is new in one run only, which names its keeper.
            return both.select("h1", "h2", n.alias("n_docs"), F.coalesce("keeper", "_keeper").alias("keeper"), seen.alias("first_seen"))

        return reduce(two, runs)

    def frequent(self, min_docs: int) -> DataFrame:
        with sorted_buckets(self.spark):
            return materialise(self._merge(self.runs()).filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper", "n_docs"), "line-frequent")


def _drop_lines(text_at: int, width: int, dropped_name: str):
    """For Arrow batches of ``width`` columns, n_lines and gone: texts lose the lines at the positions in gone."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            table = pa.Table.from_batches([batch])
            touched = table.column(width + 1).is_valid()
            whole, changed = table.filter(pa.compute.invert(touched)), table.filter(touched)
            for part, cut in ((whole, False), (changed, True)):
                if not part.num_rows:
                    continue
                counts = pa.array([0] * part.num_rows, pa.int64())
                columns = part.columns[: width + 1]
                if cut:
                    kept, dropped = [], []
                    for body, gone in zip(part.column(text_at).to_pylist(), part.column(width + 1).to_pylist(), strict=True):
                        out = set(gone)
                        kept.append("\n".join(x for i, x in enumerate(body.split("\n")) if i not in out))
                        dropped.append(len(out))
                    columns[text_at], counts = pa.chunked_array([pa.array(kept, part.schema.field(text_at).type)]), pa.array(dropped, pa.int64())
                names = [*part.schema.names[: width + 1], dropped_name]
                yield from pa.table([*columns, counts], names=names).to_batches()

    return run


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan_in: int = FAN_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop the lines whose key is in at least ``min_docs`` documents, but in the largest id that holds it.

    A key is the line without white space at both ends, A-Z lower-cased; keys of under ``min_chars`` code points are
    never dropped. Keys are compared by 128 bits of hash. Returns the rows of ``docs`` with the remaining lines as text
    (of which null and empty texts have one, empty, which stays), and two last columns ``_ld_lines`` and ``_ld_dropped``,
    the lines that each had and lost. If a column's name begins with ``_ld``, those two begin with ``_ld_`` and more
    underscores; all columns of ``docs`` pass through, whatever their names.

    A key that a document holds twice counts once, and its keeper keeps each of its lines. Rows that repeat an id count
    as one document with all their lines, and what is lost is lost at that line of each. A null id ranks below every
    other. Texts of any length are split whole. An empty table gives an empty result. Ids are numbers.
    """
    stem = free_stem(docs.columns, "_ld")
    base = docs.withColumn(text_col, text_of(text_col))
    ids = docs.select(F.col(id_col).alias("id"))
    bounds = []
    if batches > 1:
        bounds = ids.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    number = sum([(F.col("id").isNull() | (F.col("id") < F.lit(b))).cast("int") for b in bounds], F.lit(0))
    lines = (
        base.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
        .select("id", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), number.alias("batch"))
    )
    lines = materialise(lines, "lines", "batch")
    runs = LineRuns(docs.sparkSession, fan_in)
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i).select("h1", "h2", "id").distinct())
    frequent = runs.frequent(min_docs)
    runs.drop(runs.runs())
    gone = join_skewed(lines.select("id", "pos", "h1", "h2"), frequent, ["h1", "h2"], count="n_docs").filter(~F.col("id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy("id").agg(F.collect_set("pos").alias(f"{stem}_gone")).withColumnRenamed("id", f"{stem}_id")
    count = F.octet_length(text_col) - F.octet_length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1
    base = base.withColumn(f"{stem}_lines", count.cast("long"))
    joined = base.join(gone, base[id_col].eqNullSafe(gone[f"{stem}_id"]), "left").drop(f"{stem}_id")
    schema = base.schema.add(f"{stem}_dropped", "long")
    return joined.mapInArrow(_drop_lines(docs.columns.index(text_col), len(docs.columns), f"{stem}_dropped"), schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = """
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY doc_id
"""
