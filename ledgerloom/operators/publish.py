"""Publishing a run of outputs: written aside, measured while written, held by its controls, and visible as a whole or not at all.

Each output goes to a folder of the run, with a ``run_id`` column; the row count, null keys and money totals are observed
by the job that writes it. The controls that the outputs need, by a map from output to control, run once for the whole
run. Only then is the run's manifest written, one row for each output, and readers find outputs by the manifest; what a
held or interrupted run left behind is never seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import checks
from ledgerloom.plans.books import Books
from ledgerloom.plans.lineage import delete_path

Control = Callable[[Books], DataFrame]
CONTROLS: dict[str, Control] = {
    "accounting": checks.accounting_errors, "core": checks.core_errors, "compute": checks.compute_errors, "token": checks.token_errors, "seat": checks.seat_errors, "journal": checks.journal_errors,
}
#: Which controls an output needs besides those that all need.
ALWAYS = {"accounting", "core"}
NEEDED = {
    "net_rev_per_mtok": {"token", "compute"}, "cost_per_mtok": {"token", "compute"}, "model_vintage": {"token", "compute"}, "rev_per_mw": {"compute"}, "subscriptions": {"seat"},
    "journal_lines": {"journal"}, "close_accounts": {"journal"}, "close_rollforward": {"journal"}, "fact_revenue": {"journal"},
}
MANIFEST = "run_id string, run_number long, output string, folder string, row_count long, null_keys long, cents decimal(38,0)"


@dataclass
class Held(Exception):
    """A run that its controls or its own measures hold back."""

    failures: dict[str, int] = field(default_factory=dict)

    def __str__(self) -> str:
        return "report held: " + ", ".join(f"{reason}={n}" for reason, n in sorted(self.failures.items()))


def required_controls(outputs: list[str]) -> list[str]:
    return sorted(ALWAYS.union(*[NEEDED.get(name, set()) for name in outputs]))


def control_results(b: Books, outputs: list[str], controls: dict[str, Control] = CONTROLS) -> DataFrame:
    """(control, reason, failures) of all controls that the outputs need, each evaluated once."""
    parts = [controls[name](b).select(F.lit(name).alias("control"), "reason", "failures") for name in required_controls(outputs)]
    return checks.together(*parts)


class Outputs:
    """Published runs in a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest")
        except AnalysisException:  # nothing published yet
            return self.spark.createDataFrame([], MANIFEST)

    def publish(self, b: Books, outputs: dict[str, tuple[DataFrame, list[str]]], controls: dict[str, Control] = CONTROLS) -> str:
        """Write outputs, each with its key columns, and publish them together; the run's identifier, or ``Held``.

        Rows whose key is null, and none at all where an output is asked for, hold the run like a failed control.
        """
        run = uuid.uuid4().hex
        number = (self.manifest().agg(F.max("run_number")).first()[0] or 0) + 1
        rows, failures = [], {}
        try:
            for name, (df, keys) in outputs.items():
                seen, folder = Observation(f"{name}-{run}"), f"{self.path}/runs/{run}/{name}"
                lost = F.lit(False)
                for k in keys:
                    lost = lost | F.col(k).isNull()
                money = [F.col(c).cast("decimal(38,0)") for c in df.columns if c.endswith("_cents")]
                total = sum((F.coalesce(m, F.lit(0).cast("decimal(38,0)")) for m in money[1:]), F.coalesce(money[0], F.lit(0).cast("decimal(38,0)"))) if money else F.lit(0)
                measures = [F.count(F.lit(1)).alias("n"), F.count(F.when(lost, 1)).alias("null_keys"), F.sum(total.cast("decimal(38,0)")).alias("cents")]
                df.withColumn("run_id", F.lit(run)).observe(seen, *measures).write.option("compression", "zstd").parquet(folder)
                got = seen.get
                rows.append((run, number, name, folder, got["n"], got["null_keys"], got["cents"]))
                if got["null_keys"] or not got["n"]:
                    failures[f"{name}: keys" if got["null_keys"] else f"{name}: empty"] = got["null_keys"] or 1
            for r in control_results(b, list(outputs), controls).filter("failures <> 0").collect():  # a row for each named check at most
                failures[f"{r.control}: {r.reason}"] = r.failures
            if failures:
                raise Held(failures)
        except BaseException:
            delete_path(self.spark, f"{self.path}/runs/{run}")
            raise
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{run}")
        return run

    def read(self, output: str, run: str | None = None) -> DataFrame:
        """An output of one run, or of the last run that has it."""
        held = self.manifest().filter(F.col("output") == output)
        row = (held.filter(F.col("run_id") == run) if run else held).orderBy(F.desc("run_number")).first()
        if row is None:
            raise ValueError(f"no published run has {output}")
        return self.spark.read.parquet(row.folder)
