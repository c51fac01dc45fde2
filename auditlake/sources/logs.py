"""Run logs, rule-engine results, triage answers and run snapshots (A5-A10)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import NODE_DDL, RULE_RESULT_DDL

EVIDENCE_DDL = (
    "struct<id:string,source:string,checkId:string,pageUrl:string,siteId:string,fingerprint:string,criteria:array<string>,selector:string,"
    "componentSignature:string,signatureInput:string,html:string,observation:string,data:variant,engineImpact:string,screenshot:string>"
)
RESULT_DDL = (
    f"struct<url:string,siteId:string,fingerprint:string,title:string,evidence:array<{EVIDENCE_DDL}>,"
    "tabOrder:array<struct<index:int,selector:string,label:string,component:string>>,passedRules:array<string>,"
    "consent:struct<detected:boolean,dismissed:boolean,platform:string,containerSelector:string,keyboardReachable:boolean>,"
    "httpStatus:int,error:string,durationMs:bigint,coldPass:boolean>"
)
# Relations of a stored run.
RUN_RELATIONS = ["sites", "pages", "templates", "evidence", "findings"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines log as ``(value)``; a missing path is an empty log."""
    try:
        return spark.read.text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string")


def parse_results(lines: DataFrame, keep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Log lines ``(value)`` to result rows, with the line itself on demand, and rejected lines (A5).

    Blank lines are skipped; a line cut short by an interrupted write is
    rejected, not half read: it does not end the object it began.
    """
    present = lines.filter(F.trim("value") != "")
    whole = F.try_parse_json("value").isNotNull()
    parsed = present.withColumn("r", F.when(whole, F.from_json("value", RESULT_DDL)))
    good = parsed.filter(F.col("r.url").isNotNull())
    results = good.select(
        "r.url", F.col("r.siteId").alias("site_id"), "r.fingerprint", "r.title", "r.evidence", F.col("r.tabOrder").alias("tab_order"),
        F.col("r.passedRules").alias("passed_rules"), "r.consent", F.col("r.httpStatus").alias("http_status"), "r.error",
        F.col("r.durationMs").alias("duration_ms"), F.coalesce("r.coldPass", F.lit(False)).alias("cold_pass"), *([keep] if keep else []),
    )
    return results, parsed.filter(F.col("r.url").isNull()).select("value")


def evidence_of(results: DataFrame) -> DataFrame:
    """Evidence rows of scan results; the open data record is kept as JSON text."""
    return results.select(F.explode("evidence").alias("e")).select(
        "e.id", "e.source", F.col("e.checkId").alias("check_id"), F.col("e.pageUrl").alias("page_url"), F.col("e.siteId").alias("site_id"),
        "e.fingerprint", "e.criteria", "e.selector", F.col("e.componentSignature").alias("component_signature"),
        F.col("e.signatureInput").alias("signature_input"), "e.html", "e.observation", F.to_json("e.data").alias("data"),
        F.col("e.engineImpact").alias("engine_impact"), "e.screenshot",
    )


def parse_rule_results(lines: DataFrame) -> DataFrame:
    """Rule-engine log lines, one page per line, to one row per page, outcome and rule."""
    rule = f"array<struct<id:string,impact:string,help:string,description:string,helpUrl:string,tags:array<string>,nodes:array<{NODE_DDL}>>>"
    page = F.from_json("value", f"struct<url:string,violations:{rule},incomplete:{rule},passes:array<struct<id:string>>>")
    pages = lines.filter(F.trim("value") != "").select(page.alias("p")).filter(F.col("p.url").isNotNull())

    def outcome(name: str, array: str) -> DataFrame:
        return pages.select(F.col("p.url").alias("page_url"), F.lit(name).alias("outcome"), F.explode(f"p.{array}").alias("v"))

    rows = outcome("violation", "violations").unionByName(outcome("incomplete", "incomplete"))
    return rows.select(
        "page_url", "outcome", F.col("v.id").alias("rule_id"), "v.impact", "v.help", "v.description", F.col("v.helpUrl").alias("help_url"),
        "v.tags", "v.nodes",
    )


def read_rule_results(spark: SparkSession, path: str) -> DataFrame:
    """A rule-engine result table already in the long form."""
    return spark.read.schema(RULE_RESULT_DDL).json(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Triage answer files ``(file, content)``, one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def load_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A run document, one nested JSON object, as relations."""
    doc = spark.read.json(path, multiLine=True)
    return {
        name: doc.select(F.explode(name).alias("x")).select("x.*")
        for name in RUN_RELATIONS
        if name in doc.columns and "array<struct" in dict(doc.dtypes)[name]
    }


def store_run(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Write the relations of one run, replacing that run only."""
    for name, df in tables.items():
        writer = df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").partitionBy("run_id")
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{root}/{name}")


def read_run(spark: SparkSession, root: str, name: str, run_id: str) -> DataFrame:
    """One relation of a stored run; other runs are pruned at the scan."""
    return spark.read.parquet(f"{root}/{name}").filter(F.col("run_id") == run_id).drop("run_id")


def write_reports(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """Report tables, one folder each, as parquet or CSV (A10)."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.format(fmt).save(f"{root}/{name}")
