"""Parameter formatting, default expressions and the characteristic string (F-X4..F-X6)."""

from __future__ import annotations

import ast
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ductlake import fixed_values as fv


def format_parameter(name: Column, value: Column) -> Column:
    """Sizes as at least four digits, angles and radii as whole numbers, the rest as they are."""
    whole = F.rint(value).try_cast("bigint")
    beyond = F.rint(value).try_cast("decimal(38,0)").cast("string")  # what 64 bits do not hold has no need of zeros
    return (
        F.when(F.upper(name).isin(fv.PADDED_PARAMS), F.when(whole.isNull(), beyond).otherwise(F.format_string("%04d", whole)))
        .when(F.upper(name).isin(fv.INTEGER_PARAMS), F.coalesce(whole.cast("string"), beyond))
        .otherwise(value.cast("string"))
    )


BINARY_NODES = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**"}
TOKEN = "struct<kind: string, name: string, value: double>"


def postfix(expression: str) -> list[tuple[str, str | None, float | None]]:
    """An arithmetic expression as postfix tokens (kind, name, value); anything outside the allow-list raises.

    Kinds: number, name, negative, the binary operators, max, min and round (of a value and its digits).
    """
    def build(node: ast.AST) -> list[tuple[str, str | None, float | None]]:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return [("number", None, float(node.value))]
        if isinstance(node, ast.Name):
            return [("name", node.id, None)]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return build(node.operand) + ([("negative", None, None)] if isinstance(node.op, ast.USub) else [])
        if isinstance(node, ast.BinOp) and type(node.op) in BINARY_NODES:
            return build(node.left) + build(node.right) + [(BINARY_NODES[type(node.op)], None, None)]
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            parts = [build(a) for a in node.args]
            if node.func.id in ("max", "min") and len(parts) > 1:
                return parts[0] + [t for part in parts[1:] for t in [*part, (node.func.id, None, None)]]
            if node.func.id == "round" and len(parts) in (1, 2):
                return parts[0] + (parts[1] if len(parts) == 2 else [("number", None, 0.0)]) + [("round", None, None)]
        raise ValueError(f"not allowed in a default expression: {ast.dump(node)}")

    try:
        return build(ast.parse(expression.strip(), mode="eval").body)
    except SyntaxError as fault:
        raise ValueError(f"not an expression: {expression}") from fault


def evaluate_postfix(tokens: Column, known: Column) -> Column:
    """Value of postfix tokens over a map of known parameters: one fold, whose state is the stack.

    A parameter that is not known, or a division by zero, makes the value null.
    """
    def step(stack: Column, token: Column) -> Column:
        size, kind = F.size(stack), token["kind"]
        a, b = F.get(stack, size - 2), F.get(stack, size - 1)
        both = a.isNotNull() & b.isNotNull()
        scale = F.pow(F.lit(10.0), b)
        value = (
            F.when(kind == "number", token["value"])
            .when(kind == "name", F.try_element_at(known, token["name"]))
            .when(kind == "negative", -b)
            .when(kind == "+", a + b).when(kind == "-", a - b).when(kind == "*", a * b).when(kind == "/", F.try_divide(a, b))
            .when(kind == "//", F.floor(F.try_divide(a, b)).cast("double"))
            .when(kind == "%", a - F.floor(F.try_divide(a, b)) * b)
            .when(kind == "**", F.pow(a, b))
            .when((kind == "max") & both, F.greatest(a, b)).when((kind == "min") & both, F.least(a, b))
            .when(kind == "round", F.rint(a * scale) / scale)
        )
        taken = F.when(kind.isin("number", "name"), 0).when(kind == "negative", 1).otherwise(2)
        return F.array_append(F.slice(stack, F.lit(1), F.greatest(size - taken, F.lit(0))), value)

    return F.get(F.aggregate(tokens, F.array().cast("array<double>"), step), 0)


def program(required: Column, defaults: Column, forced: Column) -> Column:
    """Parameter list, default and forced values of a product as one text: equal texts are settled alike."""
    def pairs(values: Column) -> Column:
        return F.transform(F.map_entries(values), lambda e: F.array(e["key"], F.coalesce(e["value"], F.lit(""))))

    return F.to_json(F.struct(required.alias("required"), pairs(defaults).alias("defaults"), pairs(forced).alias("forced")))


@lru_cache(maxsize=20_000)
def _compiled(text: str) -> tuple[list[str], dict[str, list], dict[str, list]]:
    """A program's parameter list and postfix tokens by parameter; what is no expression becomes one token `invalid`."""
    def tokens(expression: str) -> list[tuple]:
        try:
            return postfix(expression)
        except (ValueError, RecursionError, MemoryError) as fault:
            return [("invalid", str(fault), None)]

    given = json.loads(text)
    return given.get("required") or [], *({k: tokens(v) for k, v in given.get(name) or []} for name in ("defaults", "forced"))


def _evaluate(tokens: list[tuple], known: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As `evaluate_postfix`, for n rows at once: values and which of them are there, from those of the known parameters."""
    stack = []
    for kind, name, value in tokens:
        if kind == "number":
            stack.append((np.full(n, value), np.ones(n, bool)))
        elif kind == "name":
            stack.append(known(name))
        elif kind == "negative":
            a, there = stack.pop()
            stack.append((-a, there))
        elif kind == "invalid":
            return np.full(n, np.nan), np.zeros(n, bool)
        else:
            (b, there_b), (a, there_a) = stack.pop(), stack.pop()
            there = there_a & there_b
            if kind in ("/", "//", "%"):
                there = there & (b != 0)
                found = a / b
                if kind != "/":  # a whole number of 64 bits, as columns have it
                    found = np.nan_to_num(np.clip(np.floor(found), -(2.0**63), 2.0**63), nan=0.0) + 0.0
                if kind == "%":
                    found = a - found * b
            elif kind == "round":
                scale = np.power(10.0, b)
                there = there & (scale != 0)
                found = np.rint(a * scale) / scale
            else:
                found = {"+": np.add, "-": np.subtract, "*": np.multiply, "**": np.power, "max": np.maximum, "min": np.fmin}[kind](a, b)
            stack.append((found, there))
    return stack[0]


SETTLED = "settled array<double>, missing string, invalid string"


def settle(programs: pa.Array, params: pa.Array) -> pa.Array:
    """Per row the values of the listed parameters, the first one missing, and why if its expression is invalid.

    Parameters are settled in the listed order, so an expression sees the ones before it.  A value that an
    invalid expression should give is missing.  The rows of one program are computed together, a whole column a step.
    """
    import pyarrow.compute as pc

    n = len(programs)
    offsets = params.offsets.to_numpy()
    names = pc.dictionary_encode(params.keys.slice(offsets[0], offsets[-1] - offsets[0]))
    items = params.items.slice(offsets[0], offsets[-1] - offsets[0])
    values, filled = items.fill_null(np.nan).to_numpy(zero_copy_only=False), items.is_valid().to_numpy(zero_copy_only=False)
    codes, rows = names.indices.to_numpy(), np.repeat(np.arange(n), np.diff(offsets))
    given = {}
    for code, name in enumerate(names.dictionary.to_pylist()):
        value, there = np.full(n, np.nan), np.zeros(n, bool)
        at = codes == code
        value[rows[at]], there[rows[at]] = values[at], filled[at]
        given[name] = value, there
    nowhere = np.full(n, np.nan), np.zeros(n, bool)

    encoded = pc.dictionary_encode(programs)
    kinds = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(kinds, kind="stable")
    starts = np.searchsorted(kinds[order], np.arange(len(encoded.dictionary) + 1))
    width, done = np.zeros(n, np.int64), []
    missing, invalid = np.full(n, None, object), np.full(n, None, object)
    with np.errstate(all="ignore"):
        for kind, text in enumerate(encoded.dictionary.to_pylist()):
            required, defaults, forced = _compiled(text)
            here = order[starts[kind]:starts[kind + 1]]
            if not required:
                continue
            settled = {}

            def known(name):
                if name not in settled:
                    settled[name] = tuple(x[here] for x in given.get(name, nowhere))
                return settled[name]

            columns = []
            for p in required:
                value, there = known(p)
                if p in defaults and not there.all():
                    other, also = _evaluate(defaults[p], known, len(here))
                    value, there = np.where(there, value, other), there | also
                settled[p] = value, there
                if p in forced:
                    settled[p] = _evaluate(forced[p], known, len(here))
                columns.append(settled[p])
            width[here] = len(required)
            present = np.stack([c[1] for c in columns], axis=1)
            done.append((here, np.stack([c[0] for c in columns], axis=1), present))
            lacking = np.flatnonzero(~present.all(axis=1))
            first = np.argmin(present[lacking], axis=1)
            reasons = [next((t[1] for t in forced.get(p, defaults.get(p, [])) if t[0] == "invalid"), None) for p in required]
            missing[here[lacking]] = np.array(required, object)[first]
            invalid[here[lacking]] = np.array(reasons, object)[first]
    ends = np.cumsum(width)
    flat, there = np.full(int(width.sum()), np.nan), np.zeros(int(width.sum()), bool)
    for here, found, present in done:
        places = (ends - width)[here][:, None] + np.arange(found.shape[1])
        flat[places], there[places] = found, present
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat, pa.float64(), mask=~there))
    return pa.StructArray.from_arrays([lists, pa.array(missing, pa.string()), pa.array(invalid, pa.string())], names=["settled", "missing", "invalid"])


def settled_characteristic(required: Column, settled: Column) -> Column:
    """struct(text, missing) from the struct that `settle` returns."""
    parts = F.zip_with(required, settled["settled"], lambda p, v: F.concat(p, F.coalesce(format_parameter(p, v), F.lit("")), p, F.lit("_")))
    return F.struct(F.when(settled["missing"].isNull(), F.array_join(parts, "")).alias("text"), settled["missing"].alias("missing"))


def numeric_characteristic(
    required: Column, params: Column, defaults: Column, forced: Column
) -> Column:
    """struct(text, missing) from the rule columns themselves; all defaults are numbers."""
    def settled(p: Column) -> Column:
        return F.coalesce(
            F.try_element_at(forced, p).try_cast("double"),
            F.try_element_at(params, p),
            F.try_element_at(defaults, p).try_cast("double"),
        )
    text = F.array_join(
        F.transform(required, lambda p: F.concat(p, format_parameter(p, settled(p)), p, F.lit("_"))), ""
    )
    missing = F.get(F.filter(required, lambda p: settled(p).isNull()), 0)
    return F.struct(
        F.when(missing.isNull(), text).alias("text"), missing.alias("missing")
    )


def xml_text(value: Column) -> Column:
    """Text as XML character data."""
    escaped = F.coalesce(value.cast("string"), F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(entity))
    return escaped


def xml_element(tag: str, value: Column, indent: int) -> Column:
    """One line: `<tag>text</tag>`, or `<tag/>` when the text is empty."""
    given, pad = F.coalesce(value.cast("string"), F.lit("")), " " * indent
    return F.when(given == "", F.lit(f"{pad}<{tag}/>\n")).otherwise(
        F.concat(F.lit(f"{pad}<{tag}>"), xml_text(given), F.lit(f"</{tag}>\n"))
    )
