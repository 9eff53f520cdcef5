"""Demographic columns: school parsing, one-hot blocks, and decoding them again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekspan.functions.scalars import (
    education_level,
    education_level_old,
    school_type_category,
    school_type_category_old,
)
from weekspan.operators.features import categories_of


def sql_text(value: str) -> str:
    """SQL literal of a text value."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


PREFIXES = {"gender": "gender", "canton": "canton", "school_type": "school"}


def school_columns(users: DataFrame) -> DataFrame:
    """School type (text before " - ") and class year (number before ". Jahr", else 0) of a class level."""
    level = F.col("class_level")
    year = F.regexp_extract(level, r"(\d+)\. Jahr", 1).try_cast("int")
    return users.withColumns(
        {"school_type": F.split(level, " - ")[0], "class_year": F.coalesce(year, F.lit(0)), "study": F.col("study").cast("int")}
    )


def demographic_categories(users: DataFrame) -> dict[str, list[str]]:
    """Vocabulary of every one-hot block, in sorted order."""
    typed = school_columns(users)
    return {c: categories_of(typed, c) for c in PREFIXES}


def demographic_features(users: DataFrame, categories: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """study, class_year and 0/1 columns for gender, canton and school; pass ``categories`` to fix the schema."""
    categories = categories or demographic_categories(users)
    typed = school_columns(users)
    flags = [
        f"cast({c} = {sql_text(v)} as int) as `{prefix}_{v}`" for c, prefix in PREFIXES.items() for v in categories[c]
    ]
    return typed.selectExpr("user_id", "study", "class_year", *flags)


def demographic_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.startswith(("gender_", "canton_", "school_")) or c in ("study", "class_year")]


def numeric_feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    numeric = {"byte", "short", "integer", "long", "float", "double", "boolean"}
    return [f.name for f in df.schema if f.name not in set(exclude) and f.dataType.typeName().split("(")[0] in numeric]


def one_hot_label(df: DataFrame, prefix: str, default: str = "Unknown") -> Column:
    """Name of the first largest column with the prefix; the default when all are zero or none exists."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    if not cols:
        return F.lit(default)
    values = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cols])
    names = F.array(*[F.lit(c[len(prefix):]) for c in cols])
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    top = F.array_position(values, F.array_max(values)).cast("int")
    return F.when(total == 0, F.lit(default)).otherwise(F.element_at(names, top))


def stage1_demographics(stage1: DataFrame) -> DataFrame:
    """gender, canton, school, class year, education level and school type of the wide stage 1 table."""
    year = F.col("class_year") if "class_year" in stage1.columns else F.lit(None).cast("int")
    decoded = stage1.select(
        "user_id",
        one_hot_label(stage1, "gender_").alias("gender"),
        one_hot_label(stage1, "canton_").alias("canton"),
        one_hot_label(stage1, "school_").alias("school"),
        year.alias("class_year"),
    )
    return decoded.withColumns(
        {"education_level": education_level("class_year"), "school_type": school_type_category("school")}
    )


def stage1_demographics_v2(stage1: DataFrame) -> DataFrame:
    """Variant with study and the retention label, and categories read from the school name alone."""
    extra = [c for c in ("study", "class_year", "came_back") if c in stage1.columns]
    decoded = stage1.select(
        "user_id",
        one_hot_label(stage1, "gender_").alias("gender"),
        one_hot_label(stage1, "canton_").alias("canton"),
        one_hot_label(stage1, "school_").alias("school"),
        *extra,
    )
    if "came_back" in extra:
        decoded = decoded.withColumnRenamed("came_back", "continuation_indicator")
    return decoded.withColumns(
        {"education_level": education_level_old("school"), "school_type": school_type_category_old("school")}
    )


def demographic_index(users: DataFrame, genders: Sequence[str] | None = None) -> DataFrame:
    """Position of canton and class level in their sorted vocabularies, and one-hot gender."""
    genders = genders or categories_of(users, "gender")
    out = users.select("user_id", "gender", "canton", "class_level")
    for c in ("canton", "class_level"):
        values = categories_of(users, c)  # of checked length
        index = users.sparkSession.createDataFrame(list(enumerate(values)), f"{c}_index int, {c} string")
        out = out.join(F.broadcast(index), c)
    flags = [f"cast(gender = {sql_text(g)} as double) as `gender_{g}`" for g in genders]
    return out.selectExpr("user_id", "canton_index", "class_level_index", *flags)
