"""JSON records in and out, with fixed schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from loomlight.functions.text import KINDS

# Record names, fields and which of them may be absent ("?").
POSITION = "struct<line:int,column:int>"
RECORDS = {
    "ProjectDescription": "path string, outputDirectory string, buildScript? string",
    "FilePosition": "line int, column int",
    "CompilerError": f"type string, file string, start {POSITION}, end {POSITION}, message string",
    "FilePath": "path string",
    "FileWithLine": "path string, line int",
    "CompletionRequest": f"file string, position {POSITION}, word string",
    "Suggestion": (
        "kind string, name string, parameters? array<string>, classComment? string, type? string"
    ),
    "CursorPosition": f"file string, position {POSITION}, word string",
    "DeclarationRequest": f"cursorPosition struct<file:string,position:{POSITION},word:string>",
    "ClassComment": "className string, comment? string",
    "TypeOf": "name string, type string, comment? string",
    "TypeRequest": f"file string, position {POSITION}, word string",
    "SimulateRequest": "modelName string, options map<string,variant>",
    "SimulationResult": (
        "modelName string, variables map<string,array<double>>, warning? string"
    ),
}
CORRUPT = "_corrupt_record"


def record_schema(record: str) -> ST.StructType:
    return ST.StructType.fromDDL(RECORDS[record].replace("?", ""))


def required_fields(record: str) -> list[str]:
    return [f.name for f in record_schema(record).fields if f.name not in optional_fields(record)]


def optional_fields(record: str) -> set[str]:
    return {part.split("?")[0].split()[-1] for part in RECORDS[record].split("?")[:-1]}


def fits(value: Column, kind: ST.DataType, optional: set[str] = frozenset()) -> Column:
    """Whether a JSON value has the type as it is written: no text for a number, nothing missing or null.

    Fields in ``optional`` may be missing or null; those of inner objects may not.
    """
    written = F.schema_of_variant(value)
    if isinstance(kind, ST.StructType):
        good = F.startswith(written, F.lit("OBJECT"))
        for field in kind.fields:
            inner = F.try_variant_get(value, f"$.{field.name}", "variant")
            empty = inner.isNull() | F.is_variant_null(inner)
            own = ~empty & fits(inner, field.dataType)
            good = good & ((empty | own) if field.name in optional else own)
    elif isinstance(kind, ST.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        good = F.startswith(written, F.lit("ARRAY")) & F.forall(items, lambda x: fits(x, kind.elementType))
    elif isinstance(kind, ST.MapType):
        items = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
        good = F.startswith(written, F.lit("OBJECT")) & F.forall(items, lambda x: fits(x, kind.valueType))
    elif isinstance(kind, ST.StringType):
        good = written == "STRING"
    elif isinstance(kind, ST.DoubleType):
        good = written.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    elif isinstance(kind, ST.IntegerType):
        good = (written == "BIGINT") & F.try_variant_get(value, "$", "int").isNotNull()
    else:
        good = F.lit(True)
    return F.coalesce(good, F.lit(False))


def json_ingest(
    texts: DataFrame,
    record: str,
    column: str = "json",
    enums: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Parse JSON text as one record type; adds ``record`` and ``accepted``.

    Broken text, a missing field that is not optional, at any depth, a value of another
    JSON type and a value outside its closed list reject the row. The kind of a
    suggestion is always such a list.
    """
    enums = dict(enums or {})
    if record == "Suggestion":
        enums.setdefault("kind", KINDS)
    schema = record_schema(record).add(CORRUPT, ST.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = texts.withColumn("record", F.from_json(F.col(column), schema, options))
    fields = F.col("record")
    good = fields.isNotNull() & fields[CORRUPT].isNull()
    good = good & fits(F.try_parse_json(F.col(column)), record_schema(record), optional_fields(record))
    for name, allowed in enums.items():
        good = good & fields[name].isin(list(allowed))
    return parsed.withColumn("accepted", F.coalesce(good, F.lit(False))).withColumn(
        "record", F.col("record").dropFields(CORRUPT)
    )


def json_egress(records: DataFrame, name: str = "json") -> DataFrame:
    """Rows as JSON text; null fields are left out."""
    return records.select(F.to_json(F.struct(*records.columns)).alias(name))
