"""File and folder name checks as issue rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseaudit.functions import lexicons as lx
from proseaudit.functions import naming
from proseaudit.functions import text as tx
from proseaudit.operators.stage import settle


def check_names(items: DataFrame, name: str = "name", kind: str | None = None, lead: str = lx.LEAD_WORD) -> DataFrame:
    """Adds ``name_class``, ``defects`` and ``error`` to a mixed batch of file and folder names."""
    n = tx.strip(name)
    is_folder = F.lit(False) if kind is None else F.col(kind) == "folder"
    blank = F.coalesce(n == "", F.lit(True))
    base = naming.stem(n)
    none = F.expr("cast(array() as array<string>)")
    return items.withColumns({
        "name_class": F.when(~blank & ~is_folder, naming.naming_class(base, lead))
        .when(~blank & (F.size(naming.folder_defects(n)) == 0), "folder"),
        "defects": F.when(blank, none).when(is_folder, naming.folder_defects(n)).otherwise(naming.naming_defects(base, lead)),
        "error": F.when(blank, "Empty name provided"),
    })


def name_issues(docs: DataFrame, original: str = "original_filename", path: str | None = None, lead: str = lx.LEAD_WORD) -> DataFrame:
    """One issue per document whose name equals none of its own canonical spellings."""
    shown = F.col(original) if path is None else naming.display_name(F.col(original), F.col(path))
    staged = docs.withColumn("_name", shown).where("_name is not null")
    staged = staged.withColumn("_options", naming.name_options(naming.name_parts(F.col("_name"), lead), lead))
    staged = settle(staged, ["_name", "_options"])
    return staged.where(~naming.is_one_of(naming.stem(F.col("_name")), F.col("_options"))).select(
        "doc_id", F.lit(-1).alias("page_index"), F.lit(-1).alias("element_index"), F.lit("filename").alias("element_type"),
        F.lit("filename-convention").alias("rule_name"), F.lit("warning").alias("severity"), F.lit("filename").alias("category"),
        F.lit("The file name does not follow the naming policy").alias("description"),
        F.col("_name").alias("found_text"), naming.option_lines(F.col("_options")).alias("suggestion"),
        F.lit(None).cast("double").alias("score"), F.lit(1.0).alias("confidence"), F.lit("rule-based").alias("method"),
    )
