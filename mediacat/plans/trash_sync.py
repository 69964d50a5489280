"""PLN-7 trash sync: fold the landed trash feed into the trash set.

Pagination is followed exactly as requested: start at page 1, stop after
an empty (absent) page, a null ``next_page`` (complete) or a ``next_page``
that is not an integer greater than the current page (partial; the pages
read so far are kept). The chain is found by pointer doubling over the
page table (one row per page): after k rounds the reached set holds the
first 2^k pages of the chain, so O(log pages) small joins, each round
checkpointed. The item rows themselves are only filtered and aggregated.

MUT-6 (add_trash_hashes): only trashed assets with a valid checksum; an
sha1 already in the set, or seen earlier in the feed, is ignored (insert or
ignore, so the earliest original name wins); nothing is ever removed.
AGG-3: fetched (all items of the read pages), inserted, total, partial.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import checksum_to_hex
from ..operators.materialize import materialize
from ..operators.summary import RUN_PARTIAL, RUN_SUCCESS


@dataclass
class TrashSyncResult:
    trash: DataFrame  # next trash set (sha1, original_file_name)
    totals: DataFrame  # one row
    pages: DataFrame  # visited pages (page)


def page_table(items: DataFrame) -> DataFrame:
    """page, nxt (next page to request or null), stop ('end' | 'bad' | null).
    A page without items ends the feed whatever next page it names."""
    item = F.col("id").isNotNull() | F.col("checksum").isNotNull() | F.col("original_file_name").isNotNull()
    pages = items.groupBy("page").agg(F.min("next_page").alias("next_page"), F.max(item).alias("some"))
    pages = pages.withColumn("next_page", F.when(F.col("some"), F.col("next_page")))
    n = F.col("next_page").try_cast("int").cast("long")
    ok = n.isNotNull() & (n > F.col("page"))
    return pages.select(
        "page",
        F.when(ok, n).alias("nxt"),
        F.when(F.col("next_page").isNull(), F.lit("end")).when(~ok, F.lit("bad")).alias("stop"),
    )


def visited_pages(items: DataFrame) -> DataFrame:
    """Pages on the chain that starts at page 1 (only pages that exist)."""
    pt = materialize(page_table(items))
    present = pt.select(F.col("page").alias("p"))
    # one step: successor only when it exists (an absent page is empty: stop)
    jump = pt.join(present, pt["nxt"] == present["p"], "left").select(
        "page", F.when(F.col("p").isNotNull(), F.col("nxt")).alias("to")
    )
    jump = materialize(jump)
    reached = materialize(pt.filter(F.col("page") == 1).select("page"))
    size = reached.count()  # one number per round: the "did it grow" flag
    while True:
        step = reached.join(jump, "page").filter(F.col("to").isNotNull()).select(F.col("to").alias("page"))
        grown = materialize(reached.unionByName(step).distinct())
        new_size = grown.count()
        reached = grown
        if new_size == size:
            break
        size = new_size
        j2 = jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.page"), "left")
        jump = materialize(j2.select(F.col("a.page").alias("page"), F.col("b.to").alias("to")))
    return reached


def trashed_items(items: DataFrame) -> DataFrame:
    """The trashed assets with a valid checksum, with their ``sha1``."""
    return items.withColumn("sha1", checksum_to_hex(F.col("checksum"))).filter(
        F.coalesce(F.col("is_trashed"), F.lit(False)) & F.col("sha1").isNotNull()
    )


def trash_sync(items: DataFrame, trash: DataFrame) -> TrashSyncResult:
    """``items``: page, next_page, id, checksum, original_file_name,
    is_trashed (one row per asset; optional item_no gives in-page order)."""
    pages = visited_pages(items)
    read = items.join(pages, "page", "left_semi")
    order = "item_no" if "item_no" in items.columns else "id"
    fetched = read.filter(F.col("id").isNotNull() | F.col("checksum").isNotNull())

    valid = trashed_items(fetched)
    first = valid.groupBy("sha1").agg(
        F.min_by("original_file_name", F.struct(F.col("page"), F.col(order))).alias("original_file_name")
    )
    before = trash.select("sha1", "original_file_name")
    added = first.join(before.select("sha1"), "sha1", "left_anti")
    after = before.unionByName(added)

    # AGG-3 in one aggregate over tagged rows (no joins between one-row tables)
    pt = page_table(items)
    last = pages.agg(F.max("page").alias("last_page"))
    stop = last.join(pt, last["last_page"] == pt["page"], "left").select("last_page", "stop")

    def tag(df, f, a, t, with_stop=False):
        return df.select(
            F.lit(f).alias("f"),
            F.lit(a).alias("a"),
            F.lit(t).alias("t"),
            (F.col("last_page") if with_stop else F.lit(None).cast("long")).alias("last_page"),
            (F.col("stop") if with_stop else F.lit(None).cast("string")).alias("stop"),
        )

    stats = tag(fetched, 1, 0, 0).unionByName(tag(added, 0, 1, 1)).unionByName(tag(before, 0, 0, 1))
    stats = stats.unionByName(tag(stop, 0, 0, 0, True))
    totals = stats.agg(
        F.sum("f").cast("long").alias("fetched"),
        F.sum("a").cast("long").alias("inserted"),
        F.sum("t").cast("long").alias("total"),
        F.coalesce(F.max("stop") == "bad", F.lit(False)).alias("partial"),
        F.max("last_page").alias("last_page"),
        F.when(F.max("stop") == "bad", F.lit(RUN_PARTIAL)).otherwise(F.lit(RUN_SUCCESS)).alias("run_status"),
    )
    return TrashSyncResult(trash=after, totals=totals, pages=pages)


def clear_trash(trash: DataFrame) -> DataFrame:
    """MUT-7: an empty trash set with the same schema."""
    return trash.select("sha1", "original_file_name").limit(0)
