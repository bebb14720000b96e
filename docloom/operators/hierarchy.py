"""A tree of categories, case types, their sub-categories and the documents to file, as JSON, into four tables with keys.

Keys are places in the tree, numbered from 1 over the whole tree in the order of the document, so they need no
counter, no window and no shuffle, and the same tree gives the same keys again. A tree is one row; parts of it are flattened inside
the row.

Cases: a text that is no JSON, or a tree without categories, gives no rows; missing lists are empty; a missing ``defective`` is false; null
entries of a list of names stay as rows with a null name; a document is optional if its name says so in any case of letters; keys of trees may repeat, rows then
repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREE = "categories array<struct<name: string, summary: string, description: string, code: string, caseTypes: array<struct<name: string, code: string, defective: boolean, subCategories: array<string>, fileWith: array<string>>>>>"
#: What makes a document optional (fixed values).
OPTIONAL = ("if any", "if relevant", "if applicable", "if available")


def _list(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def _numbered(rows: DataFrame, items: Column) -> DataFrame:
    """One row an item of a list, with its place from 1 on."""
    return rows.select("tree", F.posexplode(items).alias("at", "x")).select("tree", (F.col("at") + 1).alias("sort_order"), "x.*")


def normalised(trees: DataFrame, key: str, json: str, level: str = "high") -> dict[str, DataFrame]:
    """categories, case_types, sub_categories and requirements of (key, json), each with ``tree``, its own key, its parent's key and sort_order."""
    read = trees.select(F.col(key).alias("tree"), F.from_json(json, TREE).alias("t")).select("tree", F.col("t.categories").alias("categories"))
    read = read.where("categories is not null")
    kind = "struct<name: string, code: string, defective: boolean, subCategories: array<string>, fileWith: array<string>>"
    types = F.flatten(F.transform("categories", lambda c, i: F.transform(_list(c["caseTypes"], kind), lambda t: F.struct((i + 1).alias("category_id"), *[t[f].alias(f) for f in ("name", "code", "defective", "subCategories", "fileWith")]))))
    held = read.select("tree", "categories", types.alias("types"))

    def below(field: str) -> DataFrame:
        return _numbered(held, F.flatten(F.transform("types", lambda t, i: F.transform(_list(t[field], "string"), lambda name: F.struct((i + 1).alias("case_type_id"), name.alias("name"))))))

    categories = _numbered(held, F.col("categories")).select("tree", F.col("sort_order").alias("category_id"), F.lit(level).alias("court_level"), "name", "summary", "description", "code", "sort_order")
    case_types = _numbered(held, F.col("types")).select("tree", F.col("sort_order").alias("case_type_id"), "category_id", "name", "code", F.coalesce("defective", F.lit(False)).alias("defective"), "sort_order")
    documents = below("fileWith")
    optional = F.coalesce(F.exists(F.array(*[F.lit(o) for o in OPTIONAL]), lambda o: F.contains(F.lower("name"), o)), F.lit(False))
    requirements = documents.select("tree", "case_type_id", F.col("name").alias("document_name"), F.when(optional, "optional").otherwise("required").alias("requirement_type"), "sort_order")
    return {"categories": categories, "case_types": case_types, "sub_categories": below("subCategories").select("tree", "case_type_id", "name", "sort_order"), "requirements": requirements}
