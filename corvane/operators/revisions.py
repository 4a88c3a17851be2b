"""The append-only revision log: numbering, current state, integrity, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .ranks import SPAN, number_rows, with_last

STATES = ("pending_approval", "consolidated", "incubating", "telemetry_error")


def assign_seq(new: DataFrame, log: DataFrame, arrival: list[str]) -> DataFrame:
    """Contiguous numbers after the log's highest, in arrival order; a hot id is numbered by ranges of it."""
    top = log.groupBy("id").agg(F.max("seq").alias("top"))
    if dict(new.dtypes)[arrival[0]] == "string":  # one row an id
        numbered = new.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(*arrival)))
    else:
        numbered = number_rows(new, ["id"], arrival)
    return numbered.join(top, "id", "left").withColumn("seq", (F.coalesce("top", F.lit(0)) + F.col("n")).cast("long")).drop("n", "top")


def latest(log: DataFrame) -> DataFrame:
    """The highest revision of each id; aggregated before the shuffle."""
    rest = [c for c in log.columns if c not in ("id", "seq")]
    found = log.groupBy("id").agg(F.max_by(F.struct("seq", *rest), "seq").alias("row"))
    return found.select("id", *[F.col(f"row.{c}").alias(c) for c in ("seq", *rest)])


def current_nodes(log: DataFrame) -> DataFrame:
    """Latest revisions, then without those that are errors."""
    return latest(log).where("state <> 'telemetry_error'")


def telemetry_errors(log: DataFrame) -> DataFrame:
    return latest(log).where("state = 'telemetry_error'")


def log_integrity(log: DataFrame) -> DataFrame:
    """One row: groups of repeated (id, seq) and ids whose numbers are not exactly 1 to n."""
    repeated = log.groupBy("id", "seq").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated"))
    gaps = log.groupBy("id").agg(F.min("seq").alias("a"), F.max("seq").alias("z"), F.count("*").alias("n"), F.countDistinct("seq").alias("d")).where("a <> 1 or z <> n or d <> n").agg(F.count("*").alias("broken"))
    return repeated.crossJoin(gaps)


#: Hash buckets of a snapshot whose digests are compared.
BUCKETS = 4096


def bucket_of(columns: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int").alias("__bucket")


def digests(df: DataFrame, name: str, columns: list[str], buckets: int) -> DataFrame:
    """A row for each bucket of the rows' hashes: their number and sums of hashes that don't depend on their order."""
    h = F.xxhash64(F.lit("digest"), *columns)
    return df.groupBy(bucket_of(columns, buckets)).agg(F.struct(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("xor")).alias(name))


def lost_rows(before: DataFrame, after: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``before`` that ``after`` lacks, each as many times as it lacks it; columns are alike.

    Digests of buckets are compared first, sums over the rows' hashes that don't depend
    on their order and are added up before any shuffle; only rows of buckets that
    differ are compared themselves.
    """
    columns = before.columns
    bucket = bucket_of(columns, buckets)
    both = digests(before, "a", columns, buckets).join(digests(after, "b", columns, buckets), "__bucket", "left")
    differ = F.broadcast(both.where(~F.col("a").eqNullSafe(F.col("b"))).select("__bucket"))  # ``buckets`` numbers at most
    pick = lambda df: df.select("*", bucket).join(differ, "__bucket", "left_semi").select(*columns)
    return pick(before).exceptAll(pick(after.select(*columns)))


def same_rows(a: DataFrame, b: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: whether both hold the same rows as many times, and ``n``, the rows of the first; only digests are shuffled."""
    both = digests(a, "a", a.columns, buckets).join(digests(b, "b", a.columns, buckets), "__bucket", "full_outer")
    return both.agg(F.coalesce(F.every(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("same"), F.coalesce(F.sum("a.n"), F.lit(0)).alias("n"))


def queue_status(queue: DataFrame, log: DataFrame) -> DataFrame:
    """PROCESSED once the queue row's node is in the log."""
    known = log.select(F.col("id").alias("node")).distinct()
    node = F.concat(F.lit("NODE_"), F.col("ingestion_id").cast("string"))
    return queue.withColumn("node", node).join(known.withColumn("there", F.lit(True)), "node", "left").select("ingestion_id", F.when(F.col("there"), "PROCESSED").otherwise("PENDING").alias("status"))


def log_growth(log: DataFrame, before: Column) -> DataFrame:
    """Bytes of ids, payloads and vectors (8 for each element) before and after, the growth, and the mean of an insert."""
    size = (F.octet_length("id") + F.octet_length("payload") + 8 * F.size("vector")).cast("long")
    sums = log.agg(F.sum(F.when(before, size).otherwise(0)).alias("before"), F.sum(size).alias("after"), F.avg(F.when(~before, size)).alias("mean_insert"))
    return sums.select("before", "after", (F.col("after") - F.col("before")).alias("growth"), "mean_insert")


# --- trajectories --------------------------------------------------------

def with_previous(log: DataFrame, span: int = SPAN) -> DataFrame:
    """Adds the vector of the revision before; ranges of a hot id are scanned apart."""
    return with_last(log, "vector", "previous", span)


def finite_difference(log: DataFrame) -> DataFrame:
    return with_previous(log).where("previous is not null").withColumn("delta", V.difference(F.col("vector"), F.col("previous")))


def kinetics(log: DataFrame) -> DataFrame:
    """k_cin = 0.5 |dv|^2 (1 + variance of the row's spectrum); null on the first revision."""
    step = V.squared_distance(F.col("vector"), F.col("previous"))
    return with_previous(log).withColumn("step", F.when(F.col("previous").isNotNull(), step)).withColumn("k_cin", 0.5 * F.col("step") * (1 + F.col("variance")))


def ortho_distance(spectra: DataFrame, keys: list[str]) -> DataFrame:
    """pp = |Bv|^2 and ortho = |v - B'(Bv)|^2 of vectors with their spectrum and basis, row by row."""
    parts = F.zip_with("basis", "spectrum", lambda a, s: F.transform(a["vector"], lambda x: x * s["projection"]))
    inside = F.aggregate(parts, F.transform("vector", lambda x: F.lit(0.0)), lambda acc, part: F.zip_with(acc, part, lambda x, y: x + y))
    pp = F.aggregate("spectrum", F.lit(0.0), lambda acc, s: acc + s["projection"] * s["projection"])
    return spectra.select(*keys, pp.alias("pp"), V.squared_distance(F.col("vector"), inside).alias("ortho"))


def discrimination_ratio(ortho, k_cin):
    return F.when(k_cin < 1e-12, ortho / 1e-12).otherwise(ortho / k_cin)


def upgrade_log(log: DataFrame) -> DataFrame:
    """Columns that older layouts lack, with their defaults."""
    if "seq" not in log.columns:
        log = log.withColumn("seq", F.lit(1).cast("long"))
    epoch = F.lit("EPOCH_V1")
    return log.withColumn("epoch", F.coalesce("epoch", epoch) if "epoch" in log.columns else epoch)
