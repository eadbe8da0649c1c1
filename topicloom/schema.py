"""Table schemas and the input check every public function runs once on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Decision table. Years are integers in meaning; a value that does not parse becomes null.
DECISIONS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("tipo_prov", T.StringType()),
        T.StructField("anno_dec", T.IntegerType()),
        T.StructField("num_dec", T.IntegerType()),
        T.StructField("num_sez", T.StringType()),
        T.StructField("testo", T.StringType()),
        T.StructField("dispositivo", T.StringType()),
        T.StructField("anno_nrg_sic", T.IntegerType()),
        T.StructField("nrg_sic", T.StringType()),
        T.StructField("anno_prov_orig", T.IntegerType()),
        T.StructField("num_prov_orig", T.StringType()),
        T.StructField("autorita", T.StringType()),
        T.StructField("localita", T.StringType()),
        T.StructField("materia", T.StringType()),
        T.StructField("id_materia", T.IntegerType()),
    ]
)

ENTRIES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("term", T.StringType()),
        T.StructField("tf", T.LongType()),
    ]
)


def require_columns(df: DataFrame, *names: str, what: str = "input") -> None:
    """Raise ``ValueError`` when ``df`` is no DataFrame or lacks one of ``names``."""
    if not isinstance(df, DataFrame):
        raise ValueError(f"{what} must be a DataFrame, got {type(df).__name__}")
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {', '.join(missing)}")


def require_schema(df: DataFrame, schema: T.StructType, what: str = "input") -> None:
    """Raise ``ValueError`` unless ``df`` has every field of ``schema`` with its type."""
    require_columns(df, *schema.fieldNames(), what=what)
    actual = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name} is {actual[f.name].simpleString()}, not {f.dataType.simpleString()}"
        for f in schema.fields
        if actual[f.name] != f.dataType
    ]
    if wrong:
        raise ValueError(f"{what}: {'; '.join(wrong)}")
