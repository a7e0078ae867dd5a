"""What each account looked like after the batches before: continuity across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.continuity import ACCOUNT
from ledgerloom.operators.spend import account_label, with_balances

STATE = "stmt_id string, period_start date, period_end date, closing_balance decimal(18,2)"
MONEY = "decimal(28,2)"


def last_of_account(statements: DataFrame, key: list[str]) -> DataFrame:
    """The statement of each account that ends last (ties: starts last, then by id), one row an account."""
    row = F.struct("period_end", "period_start", "stmt_id", "closing_balance")
    return statements.groupBy(*key).agg(F.max(row).alias("r")).select(
        *key, "r.stmt_id", "r.period_start", "r.period_end", F.col("r.closing_balance").cast("decimal(18,2)").alias("closing_balance"))


def since_last_batch(state: DataFrame, statements: DataFrame, key: list[str] = ACCOUNT, tolerance: float = 0.005) -> DataFrame:
    """Problems between the state of an account and its first statement of a batch, as ``continuity`` reports them.

    A statement that does not start after the one the state holds came late and is a problem of its own; if it is that
    very statement, it is none.
    """
    known = state.select(*key, F.col("stmt_id").alias("prior_id"), F.col("period_start").alias("prior_start"),
                         F.col("period_end").alias("prior_end"), F.col("closing_balance").alias("prior_close"))
    rows = with_balances(statements).join(known, key).where("stmt_id <> prior_id")
    late = rows.where("period_start <= prior_start")
    on_time = rows.where("period_start > prior_start")
    first = on_time.groupBy(*key).agg(F.min(F.struct("period_start", "stmt_id")).alias("f")).select("f.stmt_id")
    met = on_time.join(first, "stmt_id", "left_semi")
    days = F.datediff("period_start", "prior_end") - 1
    label = account_label(F.col("account"), F.col("account_last4"))

    def problem(df: DataFrame, kind: str, detail, measured, expected) -> DataFrame:
        return df.select(F.lit("account").alias("scope"), *ACCOUNT, "stmt_id", F.lit(kind).alias("kind"), detail.alias("detail"),
                         measured.cast(MONEY).alias("measured"), expected.cast(MONEY).alias("expected"))

    gaps = problem(met.where(days != 0), "period_gap", F.concat(
        label, F.lit(" has "), F.format_string("%+d", days), F.lit(" days between the last batch, ending "),
        F.col("prior_end").cast("string"), F.lit(", and the statement starting "), F.col("period_start").cast("string")), days, F.lit(0))
    chain = problem(met.where(F.abs(F.col("opening_balance") - F.col("prior_close")) > tolerance), "balance_chain", F.concat(
        label, F.lit(" opens at "), F.col("opening_balance").cast("string"), F.lit(" after the last batch closed at "),
        F.col("prior_close").cast("string")), F.col("opening_balance"), F.col("prior_close"))
    order = problem(late, "late_statement", F.concat(
        label, F.lit(" already reached "), F.col("prior_end").cast("string"), F.lit(" when the statement starting "),
        F.col("period_start").cast("string"), F.lit(" arrived")), F.lit(None), F.lit(None))
    return gaps.unionByName(chain).unionByName(order)


class AccountState:
    """Snapshots of all accounts after each published batch, in ``<root>/batch=n``.

    A batch is judged against the snapshot of the batches before it, so running it again changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str] | None = None) -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key or list(ACCOUNT)

    def before(self, batch: int) -> DataFrame:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(fs_path)
                if s.getPath().getName().startswith("batch=")] if fs.exists(fs_path) else []
        done = [n for n in done if n < batch
                and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch={n}/_SUCCESS"))]
        schema = ", ".join([*[f"{c} string" for c in self.key], STATE])
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/batch={max(done)}")

    def problems(self, batch: int, statements: DataFrame) -> DataFrame:
        return since_last_batch(self.before(batch), statements, self.key)

    def publish(self, batch: int, statements: DataFrame) -> None:
        """Write the snapshot after ``batch``: of each account whichever statement ends last."""
        now = with_balances(statements).select(*[F.col(c).cast("string") for c in self.key], "stmt_id", "period_start", "period_end", "closing_balance")
        merged = last_of_account(self.before(batch).unionByName(now), self.key)
        merged.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")
