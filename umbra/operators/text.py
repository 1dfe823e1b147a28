"""Patterned personal data in free text, JSON fields, HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}",
    "ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "card": r"\b\d{16}\b",
    "secret": r'token = "[0-9a-f]+"',
}


def redact(df: DataFrame, col: str, kinds: list[str], placeholder: str = "[{}]") -> DataFrame:
    return df.withColumn(col, reduce(lambda c, k: F.regexp_replace(c, KINDS[k], placeholder.format(k.upper())), kinds, F.col(col)))


def count_pii(df: DataFrame, col: str, kinds: list[str]) -> DataFrame:
    return df.withColumns({f"n_{k}": F.coalesce(F.regexp_count(F.col(col), F.lit(KINDS[k])), F.lit(0)).cast("bigint") for k in kinds})


def find_pii(df: DataFrame, id_col: str, col: str, kinds: list[str]) -> DataFrame:
    """One row for each finding."""
    each = F.array(*[F.transform(F.regexp_extract_all(F.col(col), F.lit(KINDS[k]), F.lit(0)), _tag(k)) for k in kinds])
    return df.select(id_col, F.explode(F.flatten(each)).alias("f")).select(id_col, "f.kind", "f.value")


def _tag(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))


def valid_cards(df: DataFrame, id_col: str, col: str) -> DataFrame:
    return find_pii(df, id_col, col, ["card"]).where(F.call_function("luhn_check", F.col("value")))


def generalize_json(df: DataFrame, col: str, path: str, name: str, expr, keep: bool = False) -> DataFrame:
    """The object's field `name`, at `path`, generalized: expr maps its text to a column. Other fields are dropped, or kept as they are.

    Null and malformed objects stay null; with `keep`, an object that lacks the field stays as it is, but for white space and the order of its fields.
    """
    new = expr(F.get_json_object(col, path))
    if not keep:
        return df.withColumn(col, F.to_json(F.struct(new.alias(name))))
    old = F.from_json(col, "map<string,variant>")
    own = F.map_concat(F.map_filter(old, lambda k, _: k != name), F.create_map(F.lit(name), new.cast("variant")))
    return df.withColumn(col, F.to_json(F.when(F.map_contains_key(old, name), own).otherwise(old)))


def strip_html(df: DataFrame, col: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace(F.col(col), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return df.withColumn(col, F.trim(F.regexp_replace(bare, r"[ \n\t]+", " ")))


