"""Validation of a frame against a declared table: all violations at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.schemas import Table


#: Values of a failed check that are shown.
EXAMPLES = 3


class InvalidFrame(ValueError):
    """Raised with one line for each violated check."""


def empty(spark: SparkSession, table: Table) -> DataFrame:
    return spark.createDataFrame([], table.schema)


def shape_problems(df: DataFrame, table: Table) -> list[str]:
    """Missing and unexpected columns, and timestamps without a zone, from the schema alone."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in table.schema}
    out = [f"{c}: missing" for c in want if c not in have] + [f"{c}: unexpected" for c in have if c not in want]
    return out + [f"{c}: timestamps must carry a zone" for c, t in want.items() if isinstance(t, T.TimestampType) and isinstance(have.get(c), T.TimestampNTZType)]


def coerce(df: DataFrame, table: Table) -> DataFrame:
    """Columns cast to the table's types (a value that does not fit becomes null), the original beside each as __raw_<name>."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in table.schema], *[F.col(f.name).alias(f"__raw_{f.name}") for f in table.schema])


def _tests(table: Table, have: T.StructType) -> list[tuple[str, str, Column, Column]]:
    """(column, check, value, failed) of every row check. A null does not fail a value check, and a column that has its type cannot fail that of types."""
    out = []
    for f in table.schema:
        raw = F.col(f"__raw_{f.name}")
        if have[f.name].dataType != f.dataType:
            out.append((f.name, "type", raw, raw.isNotNull() & F.col(f.name).isNull()))
        if not f.nullable:
            out.append((f.name, "null", raw, raw.isNull()))
    out += [(column, check, F.col(column), F.coalesce(~F.expr(condition), F.lit(False))) for column, check, condition in table.checks]
    return out


def violations(df: DataFrame, table: Table) -> DataFrame:
    """(column, check, rows, examples): how many rows fail each check, and up to three values. Needs the table's columns.

    One pass for the row checks, one grouping for the key. A row carries only its failed checks onward, and every task
    counts them and keeps the three least values of each, so only a few rows a task are shuffled.
    """
    rows, tests = coerce(df, table), _tests(table, df.schema)
    marks = [F.when(bad, F.struct(F.lit(i).alias("i"), v.cast("string").alias("value"))) for i, (_, _, v, bad) in enumerate(tests)]
    failed = rows.select(F.explode(F.array_compact(F.array(*marks))).alias("f")).select("f.i", "f.value", F.lit(1).cast("long").alias("n"))
    twice = rows.groupBy(*table.key).agg(F.count("*").alias("n")).filter("n > 1")
    repeats = twice.select(F.lit(len(tests)).alias("i"), F.concat_ws(" | ", *[F.col(k).cast("string") for k in table.key]).alias("value"), "n")
    parts = failed.unionByName(repeats).mapInArrow(_counted, "i int, n long, least array<string>")
    least = F.slice(F.sort_array(F.flatten(F.collect_list("least"))), 1, EXAMPLES)
    found = parts.groupBy("i").agg(F.sum("n").alias("rows"), least.alias("least"))
    names = [(column, check) for column, check, _, _ in tests] + [(", ".join(table.key), "unique")]
    name = lambda k: F.get(F.array(*[F.lit(x[k]) for x in names]), F.col("i"))
    examples = F.sort_array(F.transform("least", lambda v: F.coalesce(v, F.lit("null"))))
    return found.select(name(0).alias("column"), name(1).alias("check"), "rows", examples.alias("examples"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's failed checks (i, value, n): the sum of n and the least values of each check, nulls first."""
    n, least = Counter(), {}
    for b in batches:
        checks = b.column("i")
        for i in pc.unique(checks).to_pylist():
            mine = b.filter(pc.equal(checks, i))
            n[i] += pc.sum(mine.column("n")).as_py()
            values = mine.column("value")
            nulls, known = values.null_count, values.drop_null()
            found = [None] * min(nulls, EXAMPLES) + known.take(pc.bottom_k_unstable(known, min(EXAMPLES, len(known)))).to_pylist()
            least[i] = sorted([*least.get(i, []), *found], key=lambda v: (v is not None, v or ""))[:EXAMPLES]
    yield pa.RecordBatch.from_pydict({"i": list(n), "n": list(n.values()), "least": [least[i] for i in n]}, pa.schema([("i", pa.int32()), ("n", pa.int64()), ("least", pa.list_(pa.string()))]))


def validate(df: DataFrame, table: Table, origin: str) -> DataFrame:
    """The coerced frame, or InvalidFrame naming every problem. Only the report, a row for each check, reaches the driver."""
    problems = shape_problems(df, table)
    if not problems:
        found: list[Row] = violations(df, table).orderBy("column", "check").collect()
        problems = [f"{r['column']}: {r['check']} ({r['rows']} rows, such as {', '.join(r['examples'])})" for r in found]
    if problems:
        raise InvalidFrame(f"{origin} is not a valid {table.name}: " + "; ".join(problems))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema])
