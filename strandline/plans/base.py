"""Registry of queries, and test streams derived from the driver's tables, in Spark and in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(tables) under name; sql may start from the named test streams in CTES."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            need = [c for n, c in CTES.items() if f" {n} " in f" {sql} ".replace("(", " ").replace(")", " ").replace("\n", " ").replace(",", " ").replace(";", " ")]
            body = sql.strip()
            ORACLE_SQL[name] = ("WITH " + ", ".join(need) + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)) if need else body
        return fn

    return add


def r6(c: Column, name: str | None = None) -> Column:
    out = F.round(c, 6)
    return out.alias(name) if name else out


#: DuckDB forms of the test streams.
CTES = {
    "streams": "streams AS (SELECT event_id AS seq, user_id % 2 AS recording_id, event_type AS topic, epoch_us(ts) AS t_us, value FROM events)",
    "pose": "pose AS (SELECT vec_id AS seq, vec_id % 3 AS recording_id, vec_id * 0.1::DOUBLE AS ts, " + ", ".join(f"embedding[{i}]::DOUBLE AS {n}" for i, n in enumerate(("tx", "ty", "tz", "qx", "qy", "qz", "qw"), 1)) + " FROM embeddings)",
    "imu": "imu AS (SELECT vec_id AS seq, vec_id % 3 AS recording_id, vec_id * 0.01::DOUBLE AS ts, embedding[15]::DOUBLE * 60 AS ax, 9.81::DOUBLE + embedding[16]::DOUBLE * 60 AS ay, embedding[17]::DOUBLE * 60 AS az, embedding[18]::DOUBLE * 5 AS gx, embedding[19]::DOUBLE * 5 AS gy, embedding[20]::DOUBLE * 5 AS gz FROM embeddings)",
    "points": "points AS (SELECT vec_id AS pt_id, embedding[8]::DOUBLE AS x, embedding[9]::DOUBLE AS y, embedding[10]::DOUBLE AS z, CAST(floor(abs(embedding[11]::DOUBLE) * 400) AS INTEGER) AS r FROM embeddings)",
    "vertices": "vertices AS (SELECT vec_id AS v_id, embedding[12]::DOUBLE AS x, embedding[13]::DOUBLE AS y, embedding[14]::DOUBLE AS z FROM embeddings)",
    "faces": "faces AS (SELECT DISTINCT vec_id // 3 AS f_id, 3 * (vec_id // 3) AS a, 3 * (vec_id // 3) + 1 AS b, 3 * (vec_id // 3) + 2 AS c FROM embeddings WHERE 3 * (vec_id // 3) + 2 <= (SELECT max(vec_id) FROM embeddings))",
    "scene": """scene AS (SELECT vec_id AS v_id, vec_id % 8 AS kind,
        CASE WHEN vec_id % 8 IN (0, 1, 3) THEN embedding[21]::DOUBLE * 16 WHEN vec_id % 8 IN (2, 6) THEN vec_id // 8 % 5 * 0.25::DOUBLE - 0.5 WHEN vec_id % 8 = 7 THEN 3 + embedding[21]::DOUBLE * 8 ELSE 0.55::DOUBLE END AS x,
        CASE WHEN vec_id % 8 IN (0, 1) THEN 0::DOUBLE WHEN vec_id % 8 = 2 THEN 0.75::DOUBLE WHEN vec_id % 8 = 3 THEN 2.5::DOUBLE WHEN vec_id % 8 = 7 THEN 1 + abs(embedding[23]::DOUBLE) * 4 ELSE 0.8::DOUBLE + (vec_id // 8 + vec_id % 8) % 5 * 0.1::DOUBLE END AS y,
        CASE WHEN vec_id % 8 IN (0, 1, 3) THEN embedding[22]::DOUBLE * 16 WHEN vec_id % 8 = 7 THEN 3 + embedding[22]::DOUBLE * 8 ELSE vec_id // 40 % 5 * 0.25::DOUBLE - 0.5 END AS z FROM embeddings)""",
    "hands": "hands AS (SELECT vec_id AS det_seq, CAST((label * 31 + vec_id) % 200 AS INTEGER) AS frame_idx, CASE WHEN label % 2 = 0 THEN 'left' ELSE 'right' END AS side, abs(embedding[64]::DOUBLE) AS confidence, embedding AS flat FROM embeddings)",
    "depth_px": "depth_px AS (SELECT l_orderkey AS frame_seq, l_linenumber AS u, l_suppkey % 48 AS v, CASE WHEN l_discount = 0 THEN 0 ELSE CAST(floor(l_quantity * 100) AS INTEGER) END AS mm FROM lineitem)",
    "tf": "tf AS (SELECT c_custkey AS seq, r_name AS parent, n_name AS child FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "tracking": "tracking AS (SELECT o_orderkey AS seq, o_orderstatus AS state_str FROM orders)",
}


class Tables:
    """The driver's tables and the test streams made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _e(self, i: int) -> Column:
        return F.element_at("embedding", i).cast("double")

    @property
    def streams(self) -> DataFrame:
        return self["events"].select(F.col("event_id").alias("seq"), (F.col("user_id") % 2).alias("recording_id"), F.col("event_type").alias("topic"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "value")

    def topic(self, name: str) -> DataFrame:
        return self.streams.where(F.col("topic") == name)

    @property
    def pose(self) -> DataFrame:
        names = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
        return self["embeddings"].select(F.col("vec_id").alias("seq"), (F.col("vec_id") % 3).alias("recording_id"), (F.col("vec_id") * F.lit(0.1)).alias("ts"), *[self._e(i).alias(n) for i, n in enumerate(names, 1)])

    @property
    def imu(self) -> DataFrame:
        e = self._e
        cols = [(e(15) * 60).alias("ax"), (F.lit(9.81) + e(16) * 60).alias("ay"), (e(17) * 60).alias("az"), (e(18) * 5).alias("gx"), (e(19) * 5).alias("gy"), (e(20) * 5).alias("gz")]
        return self["embeddings"].select(F.col("vec_id").alias("seq"), (F.col("vec_id") % 3).alias("recording_id"), (F.col("vec_id") * F.lit(0.01)).alias("ts"), *cols)

    @property
    def points(self) -> DataFrame:
        e = self._e
        return self["embeddings"].select(F.col("vec_id").alias("pt_id"), e(8).alias("x"), e(9).alias("y"), e(10).alias("z"), F.floor(F.abs(e(11)) * 400).cast("int").alias("r"))

    @property
    def vertices(self) -> DataFrame:
        e = self._e
        return self["embeddings"].select(F.col("vec_id").alias("v_id"), e(12).alias("x"), e(13).alias("y"), e(14).alias("z"))

    @property
    def faces(self) -> DataFrame:
        f = F.floor(F.col("vec_id") / 3)
        return self["embeddings"].where("vec_id % 3 = 2").select(f.alias("f_id"), (3 * f).alias("a"), (3 * f + 1).alias("b"), (3 * f + 2).alias("c"))

    @property
    def scene(self) -> DataFrame:
        """A room: floor (kinds 0, 1), table top (2), ceiling (3), a wall at the table's edge (4, 5), things on the table (6) and elsewhere (7)."""
        kind, step, row = F.col("vec_id") % 8, F.floor(F.col("vec_id") / 8), F.floor(F.col("vec_id") / 40)
        wide = lambda i: self._e(i) * 16
        off = lambda i, at: at + self._e(i) * 8
        x = F.when(kind.isin(0, 1, 3), wide(21)).when(kind.isin(2, 6), step % 5 * 0.25 - 0.5).when(kind == 7, off(21, 3)).otherwise(0.55)
        y = F.when(kind.isin(0, 1), 0.0).when(kind == 2, 0.75).when(kind == 3, 2.5).when(kind == 7, 1 + F.abs(self._e(23)) * 4).otherwise(0.8 + (step + kind) % 5 * 0.1)
        z = F.when(kind.isin(0, 1, 3), wide(22)).when(kind == 7, off(22, 3)).otherwise(row % 5 * 0.25 - 0.5)
        return self["embeddings"].select(F.col("vec_id").alias("v_id"), kind.alias("kind"), x.alias("x"), y.alias("y"), z.alias("z"))

    @property
    def hands(self) -> DataFrame:
        side = F.when(F.col("label") % 2 == 0, "left").otherwise("right")
        return self["embeddings"].select(F.col("vec_id").alias("det_seq"), ((F.col("label") * 31 + F.col("vec_id")) % 200).cast("int").alias("frame_idx"), side.alias("side"), F.abs(self._e(64)).alias("confidence"), F.col("embedding").alias("flat"))

    @property
    def depth_px(self) -> DataFrame:
        mm = F.when(F.col("l_discount") == 0, 0).otherwise(F.floor(F.col("l_quantity") * 100).cast("int"))
        return self["lineitem"].select(F.col("l_orderkey").alias("frame_seq"), F.col("l_linenumber").alias("u"), (F.col("l_suppkey") % 48).alias("v"), mm.alias("mm"))

    @property
    def tf(self) -> DataFrame:
        t = self["customer"].join(self["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(self["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        return t.select(F.col("c_custkey").alias("seq"), F.col("r_name").alias("parent"), F.col("n_name").alias("child"))

    @property
    def tracking(self) -> DataFrame:
        return self["orders"].select(F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("state_str"))
