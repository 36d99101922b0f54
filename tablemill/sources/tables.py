"""Reading and writing tables: CSV folders, parquet, database tables; copy, append, overwrite, truncate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.sources import files
from tablemill.specs import TableSpec, WriteOptions, table_name

#: What readers take for null; an unquoted empty field is read as this. No text holds it.
NULL = "~\x01~"
#: Rows that go to a database in one statement.
JDBC_BATCH = 100_000


def read_csv_dir(spark: SparkSession, path: str, schemas: Mapping[str, str | T.StructType] | None = None, suffix: str = ".csv.gz", multi_line: bool = True) -> dict[str, DataFrame]:
    """One table for each file (or folder of files) with the suffix, named after it. Without a schema, types are inferred.

    A gzipped file can't be split, so where there are fewer files than tasks, rows are dealt anew before further work.
    Null is an unquoted empty field, empty text a quoted one, and a backslash with N a text like any other. Quoted texts
    may hold line breaks: then a file is one task, as a gzipped one is anyway. multi_line=False lets Spark split large
    files that aren't compressed, if no text in them has a line break.
    """
    out = {}
    for name in files.names(spark, path):
        if not name.endswith(suffix):
            continue
        table = table_name(name[: -len(suffix)])
        reader = spark.read.option("header", True).option("nullValue", NULL).option("emptyValue", "").option("escape", '"').option("multiLine", multi_line)
        schema = (schemas or {}).get(table)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        df, tasks = reader.csv(f"{path}/{name}"), spark.sparkContext.defaultParallelism
        # Round-robin dealing is the only way to more than one task per gzipped file.
        out[table] = df if len(df.inputFiles()) >= tasks else df.repartition(tasks)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """Gzipped CSV with a header that read_csv_dir() reads back as it was."""
    alone = len(df.columns) == 1  # readers skip a line with nothing or white space on it
    said = {"header": "true", "compression": "gzip", "nullValue": NULL if alone else "", "emptyValue": "" if alone else '""', "quoteAll": str(alone), "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.options(**said).mode("errorifexists").csv(path)


def read_table(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """A stored table; only the columns asked for are read from its files."""
    df = spark.read.parquet(f"{root}/{table_name(name)}.parquet")
    df = df.select(*columns) if columns is not None else df
    return df.limit(limit) if limit is not None else df


def read_union(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several parquet tables as one: a single scan if they have one schema, else one for each schema.

    Where schemas differ, as those of several generations of a table do, columns get the narrowest type that holds all
    values of both (see wider()), and a column that a table lacks is null there. Types that can't be united without loss
    raise. Names that differ in case alone are one column.
    """
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for path in paths:
        schema = spark.read.parquet(path).schema
        groups.setdefault(schema.json(), (schema, []))[1].append(path)
    if len(groups) == 1:
        return spark.read.parquet(*paths)
    whole = reduce(wider, (schema for schema, _ in groups.values()))
    parts = []
    for schema, own in groups.values():
        there = {f.name.lower(): f for f in schema}
        cells = [_widened(F.col(f"`{there[n].name}`"), there[n].dataType, f.dataType).alias(f.name) if (n := f.name.lower()) in there else F.lit(None).cast(f.dataType).alias(f.name) for f in whole]
        parts.append(spark.read.parquet(*own).select(*cells))
    return reduce(DataFrame.unionByName, parts)


def _widened(c: Column, now: T.DataType, then: T.DataType) -> Column:
    """A value of one type as that of a wider one. Casts don't add fields to structs, so these are made anew."""
    if now == then:
        return c
    if isinstance(then, T.StructType) and isinstance(now, T.StructType):
        there = {f.name.lower(): f for f in now}
        fields = [_widened(c[there[n].name], there[n].dataType, f.dataType).alias(f.name) if (n := f.name.lower()) in there else F.lit(None).cast(f.dataType).alias(f.name) for f in then]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(then, T.ArrayType) and isinstance(now, T.ArrayType):
        return F.transform(c, lambda x: _widened(x, now.elementType, then.elementType))
    if isinstance(then, T.MapType) and isinstance(now, T.MapType):
        return F.map_from_arrays(F.transform(F.map_keys(c), lambda x: _widened(x, now.keyType, then.keyType)), F.transform(F.map_values(c), lambda x: _widened(x, now.valueType, then.valueType)))
    return c.cast(then)


_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_DIGITS = dict(zip(_WHOLE, (3, 5, 10, 19), strict=True))


def wider(a: T.DataType, b: T.DataType, where: str = "") -> T.DataType:
    """The narrowest type that holds every value of both, or an error.

    byte < short < int < long < decimals that have the digits; float < double, and whole numbers up to 2^24 and 2^53 as
    these hold them; date < timestamp without zone. Fields of structs, elements of arrays, and keys and values of maps
    are united likewise.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        mine, theirs = ({f.name.lower(): f for f in t} for t in (a, b))
        if len(mine) < len(a) or len(theirs) < len(b):
            raise TypeError(f"{where or 'columns'}: names that differ in case alone")
        fields = []
        for name in dict.fromkeys([*mine, *theirs]):
            x, y = mine.get(name), theirs.get(name)
            kind = wider(x.dataType, y.dataType, f"{where}.{name}".lstrip(".")) if x and y else (x or y).dataType
            fields.append(T.StructField((x or y).name, kind, not (x and y) or x.nullable or y.nullable))
        return T.StructType(fields)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType, f"{where}[]"), a.containsNull or b.containsNull)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(wider(a.keyType, b.keyType, f"{where} keys"), wider(a.valueType, b.valueType, f"{where} values"), a.valueContainsNull or b.valueContainsNull)
    if a in _WHOLE and b in _WHOLE:
        return max(a, b, key=_WHOLE.index)
    digits = [(_DIGITS[t], 0) if t in _WHOLE else (t.precision, t.scale) if isinstance(t, T.DecimalType) else None for t in (a, b)]
    if all(digits):
        scale = max(s for _, s in digits)
        if (precision := max(p - s for p, s in digits) + scale) <= 38:
            return T.DecimalType(precision, scale)
    for small, large in ((a, b), (b, a)):
        if isinstance(large, T.DoubleType) and isinstance(small, T.FloatType | T.ByteType | T.ShortType | T.IntegerType):
            return large
        if isinstance(large, T.FloatType) and isinstance(small, T.ByteType | T.ShortType):
            return large
        if isinstance(large, T.FloatType) and isinstance(small, T.IntegerType):
            return T.DoubleType()
        if isinstance(large, T.TimestampNTZType) and isinstance(small, T.DateType):
            return large
    raise TypeError(f"{where or 'types'}: {a.simpleString()} and {b.simpleString()} can't be one without loss")


def external_table(spark: SparkSession, ref: str) -> DataFrame:
    """A catalog table, a view or a parquet path that others own; raises if it isn't there. Nothing is copied."""
    if "/" in ref:
        if not files.exists(spark, ref):
            raise FileNotFoundError(ref)
        return spark.read.parquet(ref)
    if not spark.catalog.tableExists(ref):
        raise LookupError(f"no table or view {ref}")
    return spark.table(ref)


def jdbc_read_options(url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "fetchsize": str(JDBC_BATCH)}
    if column:
        if bounds is None:
            raise ValueError("a partition column needs bounds")
        options |= {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, driver: str | None = None) -> DataFrame:
    """A database table, read in ranges of a numeric column by several tasks if one is given. Bounds only cut ranges:
    rows beyond them and null are read too."""
    return spark.read.format("jdbc").options(**jdbc_read_options(url, table, column, bounds, partitions), **_driver(driver)).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "errorifexists", partitions: int | None = None, driver: str | None = None, column_types: str | None = None) -> None:
    """Store df as a database table, over at most so many connections at a time. column_types: such as "name VARCHAR(80)",
    for columns that a new table should have in another type than Spark's choice."""
    limit = ({"numPartitions": str(partitions)} if partitions else {}) | ({"createTableColumnTypes": column_types} if column_types else {})
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(JDBC_BATCH), **limit, **_driver(driver)).mode(mode).save()


def _driver(driver: str | None) -> dict[str, str]:
    return {"driver": driver} if driver else {}


def write_table(df: DataFrame, root: str, spec: TableSpec | str, options: WriteOptions | None = None, label: str | None = None) -> DataFrame:
    """Store df as a new table and return it as stored (its plan now begins at the files)."""
    name = spec if isinstance(spec, str) else spec.name
    said = options.resolve(label) if options else {}
    if said.get("partitions"):
        df = df.repartition(int(said["partitions"]))
    if said.get("sort_by"):
        df = df.sortWithinPartitions(*said["sort_by"])
    path = f"{root}/{table_name(name)}.parquet"
    df.write.option("compression", said.get("compression", "zstd")).mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_typed(df: DataFrame, root: str, name: str, schema: T.StructType) -> DataFrame:
    """Store df under a declared schema: its columns, in that order, cast to the declared types; nulls are refused
    where the schema has none."""
    if missing := {f.name for f in schema} - set(df.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    cast = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    strict = [f.name for f in schema if not f.nullable]
    if strict:
        # Checked while the rows are written, without a second pass.
        guard = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}")).cast(schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in strict else F.col(c) for c in cast.columns]
        cast = cast.select(*guard)
    return write_table(cast, root, name)


def append_table(df: DataFrame, root: str, name: str) -> None:
    """Add rows to a stored table of the same columns and types."""
    path = f"{root}/{table_name(name)}.parquet"
    there = [(f.name, f.dataType) for f in df.sparkSession.read.parquet(path).schema]
    if [(f.name, f.dataType) for f in df.schema] != there:
        raise ValueError("rows to append have other columns or types than the table")
    df.write.option("compression", "zstd").mode("append").parquet(path)


def overwrite_table(df: DataFrame, root: str, name: str) -> None:
    """Replace a stored table. df must not read the table itself: publish a new slot for that."""
    df.write.option("compression", "zstd").mode("overwrite").parquet(f"{root}/{table_name(name)}.parquet")


def truncate_table(spark: SparkSession, root: str, name: str) -> None:
    """Remove all rows and keep the schema."""
    schema = spark.read.parquet(f"{root}/{table_name(name)}.parquet").schema
    overwrite_table(spark.createDataFrame([], schema), root, name)


def drop_table(spark: SparkSession, root: str, name: str) -> None:
    files.delete(spark, f"{root}/{table_name(name)}.parquet")


def copy_table(spark: SparkSession, source: str, target: str) -> None:
    """Copy a parquet table without a shuffle."""
    spark.read.parquet(source).write.option("compression", "zstd").mode("errorifexists").parquet(target)


def dump_tables(tables: Mapping[str, DataFrame], root: str, names: Iterable[str] | None = None) -> list[str]:
    """Store every table of a source (or those named) as parquet; returns their names."""
    chosen = [n for n in tables if names is None or n in set(names)]
    for name in chosen:
        write_table(tables[name], root, name)
    return chosen
