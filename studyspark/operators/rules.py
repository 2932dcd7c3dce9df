"""User-written derivation rules (dicts) as Column expressions."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyspark.functions.coerce import nan_to_null, numeric_of
from studyspark.operators.standardise import months_since_baseline

Rule = Mapping[str, Any]
FORMULA_TEXT = re.compile(r"[\w\s+\-*/().]+")
BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)).cast("double"),
    ast.Pow: lambda a, b: F.when((a != 0) | (b >= 0), F.pow(a, b)),
}


class RuleError(ValueError):
    """A rule that cannot be applied to this table."""


def keyword_label(
    text: Column, mappings: Sequence[Mapping[str, Any]], default: str, match: str = "substring"
) -> Column:
    """Label of the first mapping with a keyword in the text; NULL text gives the default."""
    low = F.lower(text.cast("string"))
    out = F.when(F.lit(False), F.lit(default))
    for m in mappings:
        words = [w.lower() for w in m["keywords"]]
        if not words:
            continue
        if match == "word":
            pattern = "|".join(re.escape(w) for w in words)
            hit = low.rlike(rf"(?<!\w)({pattern})(?!\w)")
        else:
            hit = low.contains(words[0])
            for w in words[1:]:
                hit = hit | low.contains(w)
        out = out.when(hit, F.lit(m["label"]))
    return out.otherwise(F.lit(default))


def bin_label(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins; the lowest edge and everything outside give NULL."""
    if len(labels) != len(edges) - 1:
        raise RuleError(f"{len(edges)} edges need {len(edges) - 1} labels, got {len(labels)}")
    if list(edges) != sorted(set(edges)):
        raise RuleError("bin edges must increase")
    i = sum(((x > float(e)).cast("int") for e in edges), F.lit(0))
    table = F.array(*[F.lit(label) for label in labels])
    return F.when(i.between(1, len(labels)), F.get(table, i - 1))


def lookup_label(value: Column, mapping: Mapping[str, str]) -> Column:
    """Exact lookup of the text form, with `__default__` (or 'Unknown') for the rest."""
    default = F.lit(mapping.get("__default__", "Unknown"))
    pairs = [F.lit(p) for kv in mapping.items() if kv[0] != "__default__" for p in kv]
    if not pairs:
        return default
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value.cast("string")), default)


def formula(df: DataFrame, text: str) -> Column:
    """Arithmetic over columns and numbers; the text never reaches a SQL or Python evaluator."""
    if not FORMULA_TEXT.fullmatch(text):
        raise RuleError(f"illegal characters in formula {text!r}")
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise RuleError(f"cannot read formula {text!r}") from e

    def build(node: ast.expr) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in BINARY:
            return BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            inner = build(node.operand)
            return -inner if isinstance(node.op, ast.USub) else inner
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in df.columns:
                raise RuleError(f"formula {text!r} names unknown column {node.id!r}")
            return numeric_of(df, node.id)
        raise RuleError(f"formula {text!r} uses an operation that is not allowed")

    return nan_to_null(build(tree))


def _keyword_map(df: DataFrame, r: Rule) -> DataFrame:
    default = r.get("default", "OTHER")
    if r["source_col"] not in df.columns:
        return df.withColumn(r["output_col"], F.lit(default))
    label = keyword_label(
        F.col(r["source_col"]), r.get("mappings", []), default, r.get("match", "substring")
    )
    return df.withColumn(r["output_col"], label)


def _months(df: DataFrame, r: Rule) -> DataFrame:
    if r["time_col"] not in df.columns or r["entity_id_col"] not in df.columns:
        return df
    output = r.get("output_col", "months_since_baseline")
    return months_since_baseline(df, r["entity_id_col"], r["time_col"], output)


def _numeric_bin(df: DataFrame, r: Rule) -> DataFrame:
    if r["source_col"] not in df.columns:
        return df
    label = bin_label(numeric_of(df, r["source_col"]), r["bins"], r["labels"])
    return df.withColumn(r["output_col"], label)


def _proxy_label(df: DataFrame, r: Rule) -> DataFrame:
    mapping = r.get("mapping", {})
    if r["source_col"] not in df.columns:
        return df.withColumn(r["output_col"], F.lit(mapping.get("__default__", "Unknown")))
    return df.withColumn(r["output_col"], lookup_label(F.col(r["source_col"]), mapping))


def _formula(df: DataFrame, r: Rule) -> DataFrame:
    return df.withColumn(r["output_col"], formula(df, r.get("expression", "")))


KINDS = {
    "keyword_map": _keyword_map,
    "months_since_baseline": _months,
    "numeric_bin": _numeric_bin,
    "proxy_label": _proxy_label,
    "formula": _formula,
}


def apply_rules(
    df: DataFrame, rules: Sequence[Rule], strict: bool = False
) -> tuple[DataFrame, list[str]]:
    """Apply rules in order; later rules see earlier outputs. A failing rule is skipped and
    reported, or raised when `strict`."""
    issues: list[str] = []
    for i, rule in enumerate(rules):
        kind = KINDS.get(rule.get("type"))
        if kind is None:
            issues.append(f"rule {i}: unknown type {rule.get('type')!r}")
            if strict:
                raise RuleError(issues[-1])
            continue
        try:
            df = kind(df, rule)
        except (RuleError, KeyError, TypeError) as e:
            if strict:
                raise
            issues.append(f"rule {i} ({rule.get('output_col', '?')}): {e}")
    return df, issues


def validate_rules(rules: Sequence[Rule], columns: Sequence[str] | None = None) -> list[str]:
    """Problems found without running anything: missing fields, unknown types and columns."""
    out = []
    known = set(columns) if columns is not None else None
    for i, r in enumerate(rules):
        for field in ("type", "output_col"):
            if field not in r:
                out.append(f"rule {i} has no {field}")
        if "type" in r and r["type"] not in KINDS:
            out.append(f"rule {i} is of no known type: {r['type']}")
        if known is not None:
            for field in ("source_col", "time_col", "entity_id_col"):
                if field in r and r[field] not in known:
                    out.append(f"rule {i} names a column that is not there: {r[field]}")
            if "output_col" in r:
                known.add(r["output_col"])
    return out


def parse_keyword_mappings(text: str) -> list[dict[str, Any]]:
    """Lines of `word, word -> LABEL` (or the arrow sign) as mapping dicts."""
    out = []
    for line in text.strip().splitlines():
        words, arrow, label = re.sub("→", "->", line, count=1).partition("->")
        keywords = [w.strip() for w in words.split(",") if w.strip()]
        if arrow and keywords and label.strip():
            out.append({"keywords": keywords, "label": label.strip()})
    return out


def load_config(spark: SparkSession, path: str) -> dict[str, Any]:
    """A config written by `save_config`, or any JSON file, from any file system Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def save_config(spark: SparkSession, config: Mapping[str, Any], path: str) -> None:
    """One JSON text under `path`, written by Spark, so it lies where the tables lie."""
    text = json.dumps(dict(config), indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
