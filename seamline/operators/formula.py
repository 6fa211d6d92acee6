"""Formulas over named curves, compiled to Spark columns.

Numbers, curve names, + - * /, signs and the calls log, abs, sqrt, norm,
zscore, robust and minmax are allowed; all else is an error. One bad point
blocks a feature for its whole series, with a code that says why.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DOMAIN, FINITE = "invalid_math_domain", "non_finite_result"
SCALES = {"norm": "zscore", "zscore": "zscore", "robust": "robust", "minmax": "minmax"}
CALLS = {"log", "abs", "sqrt", *SCALES}


class FormulaError(ValueError):
    """A formula that isn't allowed."""


def names(expression: str) -> list[str]:
    """Curve names of a formula, in order of first use."""
    return list(dict.fromkeys(_names(_parse(expression))))


def _names(node: ast.expr) -> list[str]:
    if isinstance(node, ast.Name):
        return [node.id]
    if isinstance(node, ast.BinOp):
        return _names(node.left) + _names(node.right)
    if isinstance(node, ast.UnaryOp):
        return _names(node.operand)
    return _names(node.args[0]) if isinstance(node, ast.Call) else []


def _parse(expression: str) -> ast.expr:
    try:
        node = ast.parse(expression.strip(), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"not a formula: {expression}") from e
    _allow(node)
    return node


def _allow(node: ast.expr) -> None:
    match node:
        case ast.Constant(value=value) if isinstance(value, int | float) and not isinstance(value, bool):
            pass
        case ast.Name():
            pass
        case ast.BinOp(left=left, op=ast.Add() | ast.Sub() | ast.Mult() | ast.Div(), right=right):
            _allow(left)
            _allow(right)
        case ast.UnaryOp(op=ast.UAdd() | ast.USub(), operand=operand):
            _allow(operand)
        case ast.Call(func=ast.Name(id=name), args=[arg], keywords=[]) if name in CALLS:
            _allow(arg)
        case _:
            raise FormulaError(f"not allowed in a formula: {ast.unparse(node)}")


def _scaled(kind: str, x: Column, of: Column, w) -> tuple[Column, Column]:
    """x scaled by the statistics of ``of`` over a window, and the error where these are constant."""
    if kind == "zscore":
        spread, centre = F.stddev_pop(of).over(w), F.avg(of).over(w)
    elif kind == "minmax":
        centre = F.min(of).over(w)
        spread = F.max(of).over(w) - centre
    else:
        q = F.percentile(of, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w)
        spread, centre = q[2] - q[0], q[1]
    code = {"zscore": "zero_std", "minmax": "zero_range", "robust": "zero_iqr"}[kind]
    return F.try_divide(x - centre, F.nullif(spread, F.lit(0.0))), F.when(spread == 0, code)


def evaluate(rows: DataFrame, expression: str, keys: list[str], inside: Column | None = None, out: str = "value") -> DataFrame:
    """Rows with ``out`` and ``error`` (null where the series has none).

    ``rows`` has a column for each name and is one series for each key. Scales
    of a bare name use all of the series' finite values; scales of an
    expression, and the check for bad points, use the rows ``inside``. Rows
    outside are left out of the result.
    """
    tree, w = _parse(expression), W.partitionBy(*keys)
    within = F.lit(True) if inside is None else inside
    problems: list[Column] = []
    steps: list[tuple[str, Column]] = []

    def keep(c: Column) -> Column:
        """A named step, since windows can't be nested."""
        steps.append((f"_f{len(steps)}", c))
        return F.col(steps[-1][0])

    def build(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=value):
                return F.lit(float(value))
            case ast.Name(id=name):
                x = F.col(name).cast("double")
                problems.append(F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), FINITE))
                return x
            case ast.UnaryOp(op=op, operand=operand):
                return -build(operand) if isinstance(op, ast.USub) else build(operand)
            case ast.BinOp(left=left, op=op, right=right):
                a, b = build(left), build(right)
                if isinstance(op, ast.Div):
                    problems.append(F.when(b == 0, DOMAIN))
                    return F.try_divide(a, b)
                return a + b if isinstance(op, ast.Add) else a - b if isinstance(op, ast.Sub) else a * b
            case ast.Call(func=ast.Name(id=name), args=[arg]):
                x = build(arg)
                if name == "log":
                    problems.append(F.when(x <= 0, DOMAIN))
                    return F.when(x > 0, F.ln(x))
                if name == "sqrt":
                    problems.append(F.when(x < 0, DOMAIN))
                    return F.when(x >= 0, F.sqrt(x))
                if name == "abs":
                    return F.abs(x)
                x = keep(x)
                of = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
                value, error = _scaled(SCALES[name], x, of if isinstance(arg, ast.Name) else F.when(within, of), w)
                value, error = keep(value), keep(error)
                problems.append(error)
                return value
        raise FormulaError(ast.unparse(node))

    value = build(tree)
    for name, step in steps:
        rows = rows.withColumn(name, step)
    rows = rows.withColumn("_value", value).withColumn("_bad", F.coalesce(*problems, F.when(F.col("_value").isNull() | F.isnan("_value") | (F.abs("_value") == float("inf")), FINITE)) if problems else F.lit(None).cast("string"))
    rows = rows.filter(within).withColumn("error", F.min("_bad").over(w))
    return rows.withColumn(out, F.when(F.col("error").isNull(), F.col("_value"))).drop("_value", "_bad", *(n for n, _ in steps))


def coverage(rows: DataFrame, expressions: dict[str, str], keys: list[str]) -> DataFrame:
    """A row for each series and formula: status (ok or the error) and points."""
    reports = []
    for name, expression in expressions.items():
        done = evaluate(rows, expression, keys)
        reports.append(done.groupBy(*keys).agg(F.coalesce(F.min("error"), F.lit("ok")).alias("status"), F.count("value").alias("points")).withColumn("formula", F.lit(name)))
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out
