"""Loading source contracts from YAML or JSON files, with validation."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgergrain.operators.profile import contract_type, null_rates
from ledgergrain.specs import ColumnCheck, ColumnSpec, SourceContract

try:  # only needed for YAML files
    import yaml
except ImportError:  # pragma: no cover
    yaml = None


def _parse(path: Path) -> object:
    content = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(content)
    if yaml is None:
        raise RuntimeError("reading YAML contracts needs the yaml package; JSON works without it")
    return yaml.safe_load(content)


def validate(data: object, where: str = "contract") -> None:
    """Raise ``ValueError`` unless name, columns, types and nullable flags are all there."""
    if not isinstance(data, dict):
        raise ValueError(f"{where}: not an object")
    if not isinstance(data.get("source"), dict) or not data["source"].get("name"):
        raise ValueError(f"{where}: source.name is required")
    columns = data.get("columns")
    if not isinstance(columns, dict) or not columns:
        raise ValueError(f"{where}: columns are required")
    for name, column in columns.items():
        for need in ("type", "nullable"):
            if not isinstance(column, dict) or column.get(need) in (None, ""):
                raise ValueError(f"{where}: column {name} needs {need}")


def _check(raw: dict) -> ColumnCheck:
    affects = raw.get("affects")
    return ColumnCheck(
        raw.get("type", ""), raw.get("value"), bool(raw.get("inclusive", True)), raw.get("column"), raw.get("equals"),
        raw.get("severity"), tuple(affects) if affects else None,
    )


def from_mapping(data: dict, where: str = "contract") -> SourceContract:
    """A validated contract from parsed YAML or JSON."""
    validate(data, where)
    columns = []
    for name, c in data["columns"].items():
        rules = c.get("business_rules") if isinstance(c.get("business_rules"), dict) else {}
        values = c.get("valid_values")
        checks = c.get("checks")
        columns.append(
            ColumnSpec(
                name, str(c["type"]), bool(c["nullable"]), bool(c.get("primary_key", False)),
                tuple(values) if isinstance(values, list) else (),
                tuple(_check(k) for k in checks if isinstance(k, dict)) if isinstance(checks, list) else (),
                rules.get("require_decision_when_null_rate_ge"), rules.get("decision_reason"), c.get("logical_type"),
            )
        )
    context = data.get("business_context") or {}
    rule = (data.get("business_rules") or {}).get("refund_handling")
    positive = {}
    if isinstance(rule, dict) and rule.get("required_when_positive_column_present"):
        positive = {
            "positive_column": rule["required_when_positive_column_present"],
            "positive_severity": rule.get("severity", "must_answer"),
            "positive_affects": tuple(rule.get("affects", ("metric_logic", "sql_model", "documentation"))),
        }
    return SourceContract(
        data["source"]["name"], tuple(columns), tuple(context.get("grain", ())), context.get("final_mart"), **positive
    )


def to_mapping(contract: SourceContract) -> dict:
    """The mapping that ``from_mapping`` reads as this contract."""
    columns = {}
    for c in contract.columns:
        column = {"type": c.type, "nullable": c.nullable, "primary_key": c.primary_key, "logical_type": c.logical_type}
        if c.valid_values:
            column["valid_values"] = list(c.valid_values)
        if c.checks:
            column["checks"] = [
                {"type": k.type, "value": k.value, "inclusive": k.inclusive, "column": k.column, "equals": k.equals,
                 "severity": k.severity, "affects": list(k.affects or ())}
                for k in c.checks
            ]
        if c.null_rate_decision is not None:
            column["business_rules"] = {
                "require_decision_when_null_rate_ge": c.null_rate_decision, "decision_reason": c.decision_reason
            }
        columns[c.name] = column
    data = {
        "source": {"name": contract.name}, "columns": columns,
        "business_context": {"grain": list(contract.grain), "final_mart": contract.final_mart},
    }
    if contract.positive_column:
        data["business_rules"] = {
            "refund_handling": {
                "required_when_positive_column_present": contract.positive_column,
                "severity": contract.positive_severity, "affects": list(contract.positive_affects),
            }
        }
    return data


def write_contracts(spark: SparkSession, contracts: dict[str, SourceContract], folder: str) -> None:
    """One JSON file per contract, in any store that Spark writes to."""
    for name, contract in contracts.items():
        row = spark.createDataFrame([(json.dumps(to_mapping(contract)),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def read_contracts(spark: SparkSession, folder: str) -> dict[str, SourceContract]:
    """The JSON contracts below a folder in any store that Spark reads; contracts are configuration, so few and small."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    found = [from_mapping(json.loads(r.value)) for r in texts.collect() if r.value.strip()]
    return {c.name: c for c in sorted(found, key=lambda c: c.name)}


def load_contract(path: str | Path) -> SourceContract:
    path = Path(path)
    return from_mapping(_parse(path), path.name)


def load_contracts(folder: str | Path) -> dict[str, SourceContract]:
    """Every file of a folder that is a source contract; other files are left out."""
    found = {}
    for path in sorted(Path(folder).iterdir()):
        if path.suffix not in (".yml", ".yaml", ".json"):
            continue
        data = _parse(path)
        if not isinstance(data, dict) or not isinstance(data.get("source"), dict):
            continue
        if not data["source"].get("name") or not isinstance(data.get("columns"), dict):
            continue
        contract = from_mapping(data, path.name)
        found[contract.name] = contract
    return found


TYPES = {"text": T.StringType(), "real": T.DecimalType(18, 2), "integer": T.LongType()}


def struct_type(contract: SourceContract) -> T.StructType:
    """The schema to read a source with: text, exact money, long."""
    return T.StructType(
        [T.StructField(c.name, TYPES.get(contract_type(c.type), T.StringType()), c.nullable) for c in contract.columns]
    )


def contract_coverage(df: DataFrame, contract: SourceContract) -> DataFrame:
    """Declared columns next to the null counts of the live table."""
    live = null_rates(df, contract.name).select("column", "null_count", "total_rows")
    declared = df.sparkSession.createDataFrame(
        [(contract.name, c.name, c.type, c.nullable, c.primary_key) for c in contract.columns],
        "source string, column string, type string, nullable boolean, primary_key boolean",
    )
    return declared.join(live, "column", "left").select(
        "source", "column", "type", "nullable", "primary_key", "null_count", F.col("total_rows")
    )
