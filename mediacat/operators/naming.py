"""Free-name assignment (WIN-3, WIN-6).

A requested name that is free keeps its name; every other request gets the
next free ``<stem>_<K><ext>`` (K = 1, 2, ...). All first-choice requests are
reserved up front, so a suffixed name can never take a name another request
asked for; two suffixed names cannot collide because a name splits
uniquely at its last ``_<K>``.

The j-th free K of a name is ``j + #{taken K with K - rank(K) < j}`` where
``rank(K)`` is the position of K among the taken suffixes of that name.
Both the ranks and the counting are running sums inside groups
(:mod:`mediacat.operators.ranking`), so no candidate list is generated and
nothing is capped: the result is exact for any number of requests and any
number of taken names, and a hot name is spread over many tasks. Taken
suffixes of 19 digits and more are not looked at because none can be reached:
an assigned K is at most the number of taken suffixes and requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import dir_of, name_of
from .materialize import materialize
from .ranking import group_ordinal, group_running_sums
from .skew import skew_safe_join

SUFFIXED_STEM = r"(?s)^(.*)_([1-9][0-9]{0,17})\z"


def _split(path: Column) -> tuple[Column, Column, Column, Column]:
    """(has_dir, dir, stem, ext) with the name's extension rule: last dot to
    end, '' when the name ends with a dot (the stem then drops that dot)."""
    name = name_of(path)
    ext = F.regexp_extract(name, r"(\.[^.]+)\z", 1)
    stem = F.when(name.contains("."), F.regexp_extract(name, r"(?s)^(.*)\.[^.]*\z", 1)).otherwise(name)
    return path.contains("/"), dir_of(path), stem, ext


def _join_name(has_dir: Column, d: Column, stem: Column, k: Column, ext: Column) -> Column:
    nm = F.concat(stem, F.lit("_"), k.cast("string"), ext)
    return F.when(has_dir, F.concat(d, F.lit("/"), nm)).otherwise(nm)


def _near(existing: DataFrame, req: DataFrame) -> DataFrame:
    """The existing names that can matter to the requests: those asked for,
    and those that are a requested name with a suffix. The rest of a large
    archive is filtered away by one join on names."""
    has_dir, d, stem, ext = _split(F.col("_name"))
    root = F.regexp_extract(stem, SUFFIXED_STEM, 1)
    nm = F.concat(root, ext)
    plain = F.when(has_dir, F.concat(d, F.lit("/"), nm)).otherwise(nm)
    both = existing.select("_name", F.explode(F.array("_name", F.when(stem.rlike(SUFFIXED_STEM), plain))).alias("_asked"))
    wanted = req.select(F.col("_name").alias("_asked")).distinct()
    return both.filter(F.col("_asked").isNotNull()).join(wanted, "_asked", "left_semi").select("_name").distinct()


def unique_names(
    requests: DataFrame,
    existing: DataFrame,
    name_col: str = "dest",
    order_col: str = "path",
    cut_input: bool = True,
) -> DataFrame:
    """Add ``final_<name_col>`` to ``requests``: the requested name when free,
    else the smallest free suffixed name, distinct across all requests.

    ``order_col`` must be unique per request; it decides who keeps a name.
    ``existing`` holds the names already present (column ``path``).
    ``cut_input=False`` skips materialising the requests when the caller
    passes a table that is already materialised.
    """
    req = requests.select(F.col(order_col).alias("_id"), F.col(name_col).alias("_name"))
    if cut_input:
        req = materialize(req)
    if req.isEmpty():
        return requests.withColumn("final_" + name_col, F.lit(None).cast("string"))
    ex = _near(existing.select(F.col("path").alias("_name")).distinct(), req)

    # rank requests per name; existing rows sort first so a running count
    # of them says whether the name is already taken
    tagged = req.select("_name", "_id", F.lit(1).alias("_is_req")).unionByName(
        ex.select("_name", F.lit(None).cast(req.schema["_id"].dataType).alias("_id"), F.lit(0).alias("_is_req"))
    )
    ranked = group_running_sums(
        tagged,
        ["_name"],
        [F.col("_is_req"), F.col("_id")],
        {"_rank": F.col("_is_req"), "_taken": 1 - F.col("_is_req")},
    ).filter(F.col("_is_req") == 1)
    j = F.when(F.col("_taken") > 0, F.col("_rank")).otherwise(F.col("_rank") - 1)
    ranked = ranked.withColumn("_j", j)

    has_dir, d, stem, ext = _split(F.col("_name"))
    ranked = materialize(
        ranked.withColumn("_hd", has_dir).withColumn("_d", d).withColumn("_s", stem).withColumn("_e", ext)
    )
    need = ranked.filter(F.col("_j") >= 1)
    keep = ranked.filter(F.col("_j") < 1).withColumn("_final", F.col("_name"))
    if need.isEmpty():
        # no name is contested: every request keeps its name
        finals = keep.select("_id", "_final")
        return requests.join(
            finals.withColumnRenamed("_id", order_col).withColumnRenamed("_final", "final_" + name_col), order_col, "left"
        )

    # taken suffixes of the names that need one
    taken_names = ex.unionByName(req.select("_name")).distinct()
    thd, td, tstem, text = _split(F.col("_name"))
    taken = (
        taken_names.withColumn("_hd", thd)
        .withColumn("_d", td)
        .withColumn("_e", text)
        .withColumn("_full", tstem)
        .filter(F.col("_full").rlike(SUFFIXED_STEM))
        .withColumn("_s", F.regexp_extract("_full", SUFFIXED_STEM, 1))
        .withColumn("_k", F.regexp_extract("_full", SUFFIXED_STEM, 2).try_cast("long"))
        .filter(F.col("_k").isNotNull())
        .select("_hd", "_d", "_s", "_e", "_k")
    )
    key = ["_hd", "_d", "_s", "_e"]
    # one name may have very many taken suffixes: a skew-safe semi join on
    # the composite name key
    kk = F.concat_ws("\u0000", F.col("_hd").cast("string"), "_d", "_s", "_e")
    wanted = need.select(kk.alias("_kk")).distinct()
    taken = taken.withColumn("_kk", kk)
    taken = skew_safe_join(taken, wanted, "_kk", "inner", unique=F.concat_ws("\u0000", "_kk", F.col("_k").cast("string")))
    taken = taken.drop("_kk")
    taken = group_ordinal(taken, key, [F.col("_k")], name="_krank").withColumn("_gap", F.col("_k") - F.col("_krank"))

    merged = need.select(*key, F.col("_j").alias("_v"), F.lit(0).alias("_kind"), "_id", "_name", "_j").unionByName(
        taken.select(
            *key,
            F.col("_gap").alias("_v"),
            F.lit(1).alias("_kind"),
            F.lit(None).cast(req.schema["_id"].dataType).alias("_id"),
            F.lit(None).cast("string").alias("_name"),
            F.lit(None).cast("long").alias("_j"),
        )
    )
    counted = group_running_sums(
        merged, key, [F.col("_v"), F.col("_kind"), F.col("_id")], {"_below": F.col("_kind")}, inclusive=False
    ).filter(F.col("_kind") == 0)
    suffixed = counted.withColumn(
        "_final", _join_name(F.col("_hd"), F.col("_d"), F.col("_s"), F.col("_j") + F.col("_below"), F.col("_e"))
    )
    finals = keep.select("_id", "_final").unionByName(suffixed.select("_id", "_final"))
    return requests.join(
        finals.withColumnRenamed("_id", order_col).withColumnRenamed("_final", "final_" + name_col), order_col, "left"
    )
