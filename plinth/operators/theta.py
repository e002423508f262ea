"""Joins by equal keys and by order: only rows whose values are in order meet, not all rows of a key."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DatetimeType, DoubleType, FloatType, IntegralType, LongType, NumericType, StringType

LEFT, RIGHT = "plinth_left", "plinth_right"


def common(a: DataType, b: DataType) -> DataType | None:
    """The type in which two values are compared; None where that isn't plain."""
    if a == b:
        return a if isinstance(a, NumericType | DatetimeType | StringType | BooleanType) else None
    if isinstance(a, IntegralType) and isinstance(b, IntegralType):
        return LongType()
    plain = all(isinstance(x, IntegralType | FloatType | DoubleType) for x in (a, b))
    return DoubleType() if plain and DoubleType() in (a, b) else None


def _node(index: str, d: str | int, dims: int) -> str:
    return f"(({index}) * 64 + l) * {dims}L + {d}"


def noded(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tests: list[str]) -> tuple[DataFrame, DataFrame]:
    """left and right with their nodes LEFT and RIGHT; rows that can't meet any other are dropped.

    Two rows meet if their keys are equal and right's value OP left's, for each value and its OP of `tests` (<, <=, >, >=); nulls meet nothing. Right's different
    values of a key are numbered in order, so those that fit a left row are the first r: as a sum of powers of two, a few nodes of a binary tree. A right row is
    in one node of each size at most. Of several values a left row goes by the one that fewest right rows fit; an equal key and node is then one pair of rows, whose
    other values must still be compared.
    """
    own, dims = (left.columns, right.columns), len(tests)
    left, right = (x.filter(" AND ".join(f"{c} IS NOT NULL" for c in keys + values)) for x in (left, right))
    # what lies beyond the other side's outermost value
    outer = lambda x, up: x.groupBy(*keys).agg(*((F.max if (op[0] == "<") == up else F.min)(v).alias(f"plinth_b{i}") for i, (v, op) in enumerate(zip(values, tests, strict=True))))
    kept = lambda x, bounds, test: x.join(bounds, keys).filter(" AND ".join(test(v, op, f"plinth_b{i}") for i, (v, op) in enumerate(zip(values, tests, strict=True)))).select(*x.columns)
    bounds = outer(left, True), outer(right, False)
    right = kept(right, bounds[0], lambda v, op, b: f"{v} {op} {b}")
    left = kept(left, bounds[1], lambda v, op, b: f"{b} {op} {v}")

    order = [F.asc(v) if op[0] == "<" else F.desc(v) for v, op in zip(values, tests, strict=True)]
    right = right.withColumns({f"plinth_k{i}": F.dense_rank().over(Window.partitionBy(*keys).orderBy(o)).cast("long") - 1 for i, o in enumerate(order)})
    both = left.withColumn("plinth_side", F.lit(1))
    for i, (v, op) in enumerate(zip(values, tests, strict=True)):
        steps = right.groupBy(*keys, v).agg((F.max(f"plinth_k{i}") + 1).alias(f"plinth_r{i}"), F.count("*").alias(f"plinth_c{i}"))
        both = both.unionByName(steps.withColumn("plinth_side", F.lit(0 if "=" in op else 2)), allowMissingColumns=True)
    upto = [Window.partitionBy(*keys).orderBy(o, "plinth_side").rowsBetween(Window.unboundedPreceding, 0) for o in order]
    both = both.withColumns({f"plinth_r{i}": F.max(f"plinth_r{i}").over(w) for i, w in enumerate(upto)} | {f"plinth_c{i}": F.sum(f"plinth_c{i}").over(w) for i, w in enumerate(upto)})
    found = both.filter(" AND ".join(["plinth_side = 1", *(f"plinth_r{i} > 0" for i in range(dims))]))
    fewest = ", ".join(f"struct(plinth_c{i} AS c, {i}L AS d, plinth_r{i} AS r)" for i in range(dims))
    found = found.withColumn("plinth_f", F.expr(f"array_min(array({fewest}))"))
    bits = "filter(sequence(0, length(bin({n})) - 1), l -> shiftright({k}, l) % 2 = {bit})"
    down = f"transform({bits.format(n='plinth_f.r', k='plinth_f.r', bit=1)}, l -> {_node('shiftright(plinth_f.r, l) - 1', 'plinth_f.d', dims)})"
    right = right.withColumns({f"plinth_n{i}": F.max(f"plinth_k{i}").over(Window.partitionBy(*keys)) + 1 for i in range(dims)})
    up = ", ".join(f"transform({bits.format(n=f'plinth_n{i}', k=f'plinth_k{i}', bit=0)}, l -> {_node(f'shiftright(plinth_k{i}, l)', i, dims)})" for i in range(dims))
    hidden = set(keys + values)
    shown = [[f"`{c}`" for c in columns if c not in hidden] for columns in own]
    return found.select(*shown[0], F.explode(F.expr(down)).alias(LEFT)), right.select(*shown[1], F.explode(F.expr(f"concat({up})")).alias(RIGHT))
