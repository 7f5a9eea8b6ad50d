"""Raw sources to audited gold, panels included: the library's steps in their fixed order.

Tables are taken one after the other; each step on a table is a Spark job over the stored result of the step
before. What the driver holds is metadata: profiles, contracts, metric definitions and audit rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import table_ident
from ..operators import audit, bronze, gold, learn, panels, profiling, query, silver
from ..sources.discover import reader_kind, source_list
from ..sources.landing import land_table, load_gold, save_json, upsert_stage
from ..sources.readers import SourceError, read_raw
from .contract import CONTRACT_SCHEMA, Classification, GoldContract, contracts_frame, pick_fact
from .metric import Metric, auto_questions, conformance, propose_metrics, version_metrics, with_authored
from ..session import pinned, small_frame

# The stages and their order.
STAGES = ("bronze", "silver", "gold", "metrics", "reports", "panels", "model")


@dataclass
class MedallionRun:
    """Paths and metadata of a finished run."""

    spark: SparkSession
    base: str
    name: str
    catalog: list[dict] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)
    roles: dict[str, Classification] = field(default_factory=dict)
    contracts: list[GoldContract] = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)
    audit_rows: dict[str, list[tuple]] = field(default_factory=lambda: {k: [] for k in audit.AUDIT_SCHEMAS})

    def table(self, layer: str, table: str) -> DataFrame:
        frame = self.spark.read.parquet(f"{self.base}/{layer}/{table}")
        return frame.drop(gold.MONTH) if layer == "gold" else frame

    def fact_days(self, table: str, first_day: str, last_day: str) -> DataFrame:
        """The rows of a fact between two days; months outside are not read."""
        contract = next(c for c in self.contracts if c.table == table)
        return gold.read_fact(self.spark, f"{self.base}/gold/{table}", contract.grain, first_day, last_day)

    def facts(self) -> dict[str, tuple[DataFrame, list[str]]]:
        return {c.table: (self.table("gold", c.table), c.dims) for c in self.contracts if c.kind == "fact"}

    def audit(self, kind: str) -> DataFrame:
        return audit.audit_frame(self.spark, kind, self.audit_rows[kind])

    def conformance(self) -> DataFrame:
        return conformance(self.spark, {n: f for n, (f, _) in self.facts().items()}, self.metrics)

    def governance(self) -> dict[str, DataFrame]:
        return audit.governance_report(
            {k: self.audit(k) for k in audit.AUDIT_SCHEMAS}, self.conformance(),
            audit.access_policy(self.spark, panels.DEFAULT_ROLES, panels.RESTRICTED_OWNERS))

    def note(self, kind: str, stage: str, *values) -> None:
        self.audit_rows[kind].append((stage, STAGES.index(stage), *values))

    @property
    def status(self) -> str:
        return "partial" if self.skipped else "ok"

    def _replace(self, stage: str, lineage: DataFrame, quality: DataFrame) -> None:
        """Audit rows of a stage that may run again: its earlier rows go."""
        for kind in ("lineage", "quality"):
            self.audit_rows[kind] = [r for r in self.audit_rows[kind] if r[0] != stage]
        for r in lineage.collect():
            self.note("lineage", stage, r["output"], list(r["sources"]), r["logic"])
        for r in quality.collect():
            self.note("quality", stage, r["check"], r["result"], r["detail"])
        self.seal()

    def ask(self, questions: Sequence[str], save: bool = True) -> tuple[dict[int, DataFrame], DataFrame]:
        """Answer questions over the governed metrics, with receipts and audit rows; ``save`` also writes both as
        JSON below ``reports``. Without questions the default ones are asked."""
        dims = sorted({d for _, ds in self.facts().values() for d in ds})
        asked = list(questions) or auto_questions(self.metrics, dims)
        answers, receipts = query.answer_questions(self.spark, self.facts(), self.metrics, asked)
        self._replace("reports", *audit.report_rows(receipts))
        if save:
            save_json(receipts, f"{self.base}/reports/receipts")
            for number, answer in answers.items():
                save_json(answer, f"{self.base}/reports/q{number}")
        return answers, receipts

    def learn(self, target: str | None = None, fact: str | None = None, lam: float = 1.0):
        """Fit a ridge regression on a gold fact (default: the one with most measures); returns model and metrics."""
        contract = pick_fact(self.contracts, fact)
        model, evaluation = learn.train(self.table("gold", contract.table), contract, target, lam)
        evaluation = pinned(evaluation)
        self._replace("model", *audit.model_rows(evaluation, model.target, model.trained_on))
        where = f"{self.base}/models/{model.target}"
        wide = isinstance(model, learn.WideModel)
        if wide:
            land_table(model.weights, f"{where}/weights")
        save_json(small_frame(self.spark, [(model.to_json(), model.hash, None if wide else model.coefficients())],
                              "model string, hash string, coefficients map<string,double>"), f"{where}/model")
        save_json(evaluation, f"{where}/evaluation")
        return model, evaluation

    def model(self, target: str) -> learn.LinearModel | learn.WideModel:
        """A model that an earlier ``learn`` stored."""
        where = f"{self.base}/models/{target}"
        text = self.spark.read.json(f"{where}/model").first()["model"]
        if json.loads(text)["kind"] == learn.WIDE:
            return learn.WideModel.from_json(text, self.spark.read.parquet(f"{where}/weights"))
        return learn.LinearModel.from_json(text)

    def seal(self) -> None:
        """Work out each stage's contract from its checks and store the audit tables."""
        quality = self.audit("quality")
        self.audit_rows["contract"] = [
            (c["stage"], c["stage_no"], c["name"], c["honored"], c["violations"])
            for c in audit.contract_rows(quality, self.name).orderBy("stage_no").collect()]
        for kind in audit.AUDIT_SCHEMAS:
            if self.audit_rows[kind]:
                upsert_stage(self.audit(kind), f"{self.base}/audit/{kind}")


def _land_source(run: MedallionRun, path: str, modified: datetime, pii_extra: Mapping[str, str], exact: bool,
                 owner: str) -> None:
    """One source to raw and bronze, with its catalog entry."""
    file_name = path.rsplit("/", 1)[-1]
    table = table_ident(file_name.rpartition(".")[0] or file_name, [c["table"] for c in run.catalog])
    kind = "document" if reader_kind(path) in ("pdf", "image", "text") else "tabular"
    raw = land_table(read_raw(run.spark, path), f"{run.base}/raw/{table}")
    profile = profiling.profile_columns(raw, table, exact)
    profile = pinned(profile)
    if not exact:
        confirmed = [r["column"] for r in profiling.confirm_keys(raw, profile).collect()]
        unique = F.col("column").isin(*confirmed) if confirmed else F.lit(False)
        profile = profile.withColumn("distinct", F.when(unique, F.col("rows"))
                                     .otherwise(F.least("distinct", F.greatest(F.col("rows") - 1, F.lit(1)))))
    pii = profiling.detect_pii(raw, profile, table, extra=pii_extra)
    pii = pinned(pii)
    samples = profiling.column_samples(raw)
    entries = bronze.catalog_rows(profile, samples, pii, profiling.dim_candidates(profile, pii))
    land_table(entries.withColumn("source_file", F.lit(file_name)).withColumn("kind", F.lit(kind))
               .withColumn("freshness", F.lit(modified)).withColumn("owner", F.lit(owner)),
               f"{run.base}/catalog/{table}")
    types = {r["column"]: r["type"] for r in bronze.wide_integer_types(profile).collect()}
    land_table(bronze.cast_bronze(raw, types), f"{run.base}/bronze/{table}")
    run.catalog.append({"table": table, "kind": kind, "source_file": file_name, "freshness": modified,
                        "types": types, "owner": owner})
    run.roles[table] = profiling.to_classification(profiling.classify_columns(profile, pii))
    run.note("lineage", "bronze", f"bronze.{table}", [f"file:{file_name}"], f"typed from {kind} source")
    for p in pii.orderBy("ordinal").collect():
        run.note("pii", "bronze", f"{table}.{p['column']}", p["class"], p["action"])
    for q in profiling.quality_checks(profile).collect():
        run.note("quality", "bronze", q["check"], q["result"], q["detail"])


def build_gold(silver_df: DataFrame, table: str, roles: Classification, owner: str = "unassigned",
               distinct_cols: Sequence[str] = (), exact: bool = True) -> tuple[DataFrame, GoldContract]:
    """The gold table a silver table gives, and its contract: a daily fact if it has a date and a measure, else
    a dimension without its personal data."""
    if roles.is_fact:
        fact = gold.build_daily_fact(silver_df, roles.grain, roles.dims, roles.measures, table, distinct_cols, exact)
        return fact, GoldContract(
            f"agg_{table}_daily", "fact", owner, f"{roles.grain}_day", roles.dims, roles.measures, f"{table}_count",
            {m: roles.types.get(m, "real") for m in roles.measures})
    dim = gold.conform_dimension(silver_df, roles.pii)
    return dim, GoldContract(f"dim_{table}", "dim", owner, keys=[k for k in roles.keys if k not in roles.pii],
                             dropped=roles.pii)


def _refine(run: MedallionRun, entry: dict, distinct_cols: Sequence[str]) -> None:
    """One bronze table to silver and gold."""
    spark, table = run.spark, entry["table"]
    roles = run.roles[table]
    landed = spark.read.parquet(f"{run.base}/bronze/{table}")
    clean = land_table(silver.clean_silver(landed, entry["types"], roles.keys), f"{run.base}/silver/{table}")
    receipt = silver.dedupe_receipt(landed, clean, table).first()
    run.note("lineage", "silver", f"silver.{table}", [f"bronze.{table}"],
             f"cleaned and de-duplicated on {', '.join(roles.keys) or 'all columns'}")
    run.note("quality", "silver", f"silver.{table} dedupe", "pass",
             f"{receipt['bronze_rows']}->{receipt['silver_rows']} rows ({receipt['dropped']} dropped)")

    kept = [c for c in distinct_cols if c in clean.columns]
    data = clean.select(*[F.col(f"`{c}`") for c in entry["types"]])
    built, contract = build_gold(data, table, roles, entry["owner"], kept)
    run.contracts.append(contract)
    where = f"{run.base}/gold/{contract.table}"
    if contract.kind == "dim":
        stored = land_table(built, where)
        run.note("lineage", "gold", f"gold.{contract.table}", [f"silver.{table}"],
                 f"dimension without {', '.join(contract.dropped) or 'changes'}")
        run.note("quality", "gold", f"gold.{contract.table} conformed", "pass",
                 f"{stored.count()} rows; dropped: {', '.join(contract.dropped) or 'none'}")
        for column in contract.dropped:
            run.note("dropped", "gold", table, column)
        return
    stored = gold.write_fact(built, where, contract.grain)
    run.note("lineage", "gold", f"gold.{contract.table}", [f"silver.{table}"],
             f"by day x {', '.join(contract.dims) or 'nothing'}: sums of {', '.join(contract.measures)}, count")
    for r in gold.reconcile(clean, stored, contract.measures).orderBy("measure").collect():
        run.note("quality", "gold", f"gold.{contract.table} reconciles {r['measure']}", r["result"],
                 f"silver {r['silver_sum']} gold {r['gold_sum']}")
    rows = gold.reconcile_rows(clean, stored, contract.count_col).first()
    run.note("quality", "gold", f"gold.{contract.table} reconciles {contract.count_col}", rows["result"],
             f"silver {rows['silver_rows']} gold {rows['gold_rows']}")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of an earlier run, held on the driver since its path is about to be overwritten; None if absent."""
    try:
        return pinned(spark.read.parquet(path))
    except AnalysisException:
        return None


def _contracts_of(rows: DataFrame) -> list[GoldContract]:
    return [GoldContract(**{k: v for k, v in r.asDict(recursive=True).items() if v is not None})
            for r in rows.orderBy("table").collect()]  # one row per gold table


def _audit_of(spark: SparkSession, base: str) -> dict[str, list[tuple]]:
    """The audit rows that a run stored, as its driver-side lists."""
    found: dict[str, list[tuple]] = {}
    for kind in audit.AUDIT_SCHEMAS:
        stored = _stored(spark, f"{base}/audit/{kind}")
        names = audit.audit_frame(spark, kind, []).columns
        found[kind] = [] if stored is None else [tuple(r[n] for n in names) for r in stored.collect()]
    return found


def open_run(spark: SparkSession, base: str, name: str = "run") -> MedallionRun:
    """A finished run from its folder: contracts, metrics with their versions, and audit rows. Questions, panels and
    models work as they do right after the run; nothing is landed again."""
    base = base.rstrip("/")
    contracts = _contracts_of(spark.read.parquet(f"{base}/contracts"))
    store = spark.read.parquet(f"{base}/metrics").where("status <> 'removed'").orderBy("metric").collect()
    metrics = [Metric.from_dict({**r.asDict(recursive=True), "version": f"v{r['version']}"}) for r in store]
    return MedallionRun(spark, base, name, contracts=contracts, metrics=metrics, audit_rows=_audit_of(spark, base))


def run_from_gold(spark: SparkSession, tables: Mapping[str, str], contracts: Sequence[GoldContract], base: str,
                  name: str = "run", authored: Sequence[Metric] = (), cadence: str = "daily") -> MedallionRun:
    """Start from gold that somebody else built: ``tables`` names where each contract's table lies. Metrics, panels,
    questions and models follow as after ``run_medallion``."""
    run = MedallionRun(spark, base.rstrip("/"), name, contracts=list(contracts))
    for contract in run.contracts:
        supplied = load_gold(spark, tables[contract.table])
        where = f"{run.base}/gold/{contract.table}"
        stored = gold.write_fact(supplied, where, contract.grain) if contract.kind == "fact" else land_table(supplied, where)
        run.note("lineage", "gold", f"gold.{contract.table}", [f"file:{tables[contract.table].rsplit('/', 1)[-1]}"], "supplied")
        missing = sorted({*contract.dims, *contract.measures, contract.grain, contract.count_col} - {None, *stored.columns})
        run.note("quality", "gold", f"gold.{contract.table} has its contract's columns", "fail" if missing else "pass",
                 f"missing: {', '.join(missing) or 'none'}")
    land_table(contracts_frame(spark, run.contracts), f"{run.base}/contracts")
    _publish(run, authored, cadence)
    return run


def run_medallion(spark: SparkSession, paths: list[str], base: str, name: str = "run",
                  authored: Sequence[Metric] = (), pii_extra: Mapping[str, str] | None = None,
                  distinct_cols: Sequence[str] = (), exact_profile: bool = True,
                  owners: Mapping[str, str] | None = None, cadence: str = "daily") -> MedallionRun:
    """Land, clean, aggregate, define metrics, build panels and audit. Sources that cannot be read are reported in
    ``skipped`` and do not stop the others."""
    run = MedallionRun(spark, base.rstrip("/"), name)
    for path, modified in source_list(spark, paths):
        file_name = path.rsplit("/", 1)[-1]
        try:
            _land_source(run, path, modified, pii_extra or {}, exact_profile,
                         (owners or {}).get(file_name, "unassigned"))
        except SourceError as error:
            run.skipped.append((file_name, str(error)))
        except PySparkException as error:
            run.skipped.append((file_name, str(error)))
    if not run.catalog and not run.skipped:
        raise ValueError("no supported source files found")
    for entry in run.catalog:
        if entry["kind"] == "tabular":
            _refine(run, entry, distinct_cols)
    land_table(contracts_frame(spark, run.contracts) if run.contracts else small_frame(spark, [], CONTRACT_SCHEMA),
               f"{run.base}/contracts")

    _publish(run, authored, cadence)
    return run


def _publish(run: MedallionRun, authored: Sequence[Metric], cadence: str) -> None:
    """Metrics, conformance, panels and the sealed audit of a run whose gold is stored."""
    spark = run.spark
    defined = with_authored(propose_metrics(run.contracts), list(authored), run.contracts)
    run.metrics, store = version_metrics(spark, defined, _stored(spark, f"{run.base}/metrics"))
    land_table(store, f"{run.base}/metrics")
    facts = run.facts()
    checked = run.conformance().orderBy("metric").collect()
    for r in checked:
        metric = next(m for m in run.metrics if m.metric == r["metric"])
        run.note("lineage", "metrics", f"metric.{r['metric']}", [f"gold.{metric.fact}"],
                 f"{r['aggregation']} ({r['class']}) {metric.version}")
        run.note("quality", "metrics", f"metric {r['metric']} conforms", r["result"],
                 r["error"] or r["definition"] or ", ".join(r["issues"]))
    sound = {r["metric"] for r in checked if r["result"] == "pass"}
    usable = [m for m in run.metrics if m.metric in sound]
    if usable:
        shown = panels.refresh_panels(spark, facts, usable, f"{run.base}/panels", cadence)
        for p in shown.select("panel_id", "kind", "metric", "visible_to").distinct().orderBy("panel_id").collect():
            run.note("lineage", "panels", f"panel.{p['panel_id']}", [f"metric.{p['metric']}"],
                     f"{p['kind']} panel for {', '.join(p['visible_to'])}")
        run.note("quality", "panels", "panels built", "pass", f"{len(usable)} metrics")
    run.seal()
