"""Reading labelled text: schema check, null rules, label decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

NAMES = ("negative", "neutral", "positive")


def validate_schema(schema: T.StructType, text_col: str = "review_text", label_col: str = "sentiment") -> None:
    """Raises ValueError unless the text is a string and the label a string or an integer; columns are found by name."""
    kinds = {f.name: f.dataType for f in schema.fields}
    for name in (text_col, label_col):
        if name not in kinds:
            raise ValueError(f"missing column: {name}")
    if not isinstance(kinds[text_col], T.StringType):
        raise ValueError(f"column {text_col} must be a string, is {kinds[text_col].simpleString()}")
    if not isinstance(kinds[label_col], (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"column {label_col} must be a string or an integer, is {kinds[label_col].simpleString()}")


def parse_label(label: Column, kind: T.DataType, strict: bool = True) -> Column:
    """0, 1 or 2. Names compare ignoring case, untrimmed; numbers must lie in 0..2. Anything else raises, or is null if not strict."""
    bad = F.raise_error(F.concat(F.lit("Unknown sentiment label: "), label.cast("string"))).cast("int") if strict else F.lit(None).cast("int")
    if isinstance(kind, T.StringType):
        known = F.lower(label)
        out = F.when(known == NAMES[0], 0).when(known == NAMES[1], 1).when(known == NAMES[2], 2)
    else:
        out = F.when(label.between(0, 2), label.cast("int"))
    return out.otherwise(bad)


def read_labelled(df: DataFrame, text_col: str = "review_text", label_col: str = "sentiment", keep: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """(keep..., text, label) of rows with text and label; null and '' texts and null labels are skipped.

    The label is decoded only where the row stays, so a bad label of a skipped row is no error.
    With strict=False rows of unknown labels are dropped instead of raising.
    """
    validate_schema(df.schema, text_col, label_col)
    stays = F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & (F.col(text_col) != "")
    label = F.when(stays, parse_label(F.col(label_col), df.schema[label_col].dataType, strict))
    out = df.where(stays).select(*keep, F.col(text_col).alias("text"), label.alias("label"))
    return out if strict else out.where("label is not null")


def read_stats(df: DataFrame, text_col: str = "review_text", label_col: str = "sentiment") -> DataFrame:
    """One row: total_rows, null_text, null_label, empty_text, kept_rows, tested in that order."""
    t, s = F.col(text_col), F.col(label_col)
    return df.agg(
        F.count("*").alias("total_rows"), F.count_if(t.isNull()).alias("null_text"), F.count_if(t.isNotNull() & s.isNull()).alias("null_label"),
        F.count_if(t.isNotNull() & s.isNotNull() & (t == "")).alias("empty_text"), F.count_if(t.isNotNull() & s.isNotNull() & (t != "")).alias("kept_rows"),
    )


def literal(spark: SparkSession, text: str) -> DataFrame:
    """A one-row table of a given text, for the transforms that take any table."""
    return spark.createDataFrame([(0, text)], "doc_id bigint, text string")
