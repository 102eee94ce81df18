"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

Targets.  Sources weigh 1, 2, 3 and so on in code point order (null last) and
share all sizes; a target stops at ``cap`` times its source's size and the
excess is shared again by weight until none is above.  That fixed point is
target = min(weight * level, cap * size) with one level for all; the level
rises from round to round as sources are capped, and each round is one sum
over the table of sources.

Copies.  A document of a source takes target / size copies, on average.  The
whole part is certain; the fraction p is decided by pivotal rounding weighted
by size: of two undecided documents, mass moves from one to the other, in a
random direction with odds that keep each one's mean, until one of them is
decided.  The sum of p * size never changes; the last undecided document of a
source goes to its nearer end, so the source's words miss their target by at
most half of that document.  Blocks of about ``FAN`` documents are folded at
once; the one document left of each block goes on to the next level of the
tree, ``FAN`` blocks to one, until one is left.  No task holds more than a few
blocks of a source at a time, whatever its share.

Rows alike in doc_id, text and source are one group with a count: n of them at
p settle among themselves until floor(n p) are taken, the others but one are
not, and that one enters the tree with what is left.  Which of the equal rows
is taken makes no difference.

Random numbers are hashes of ids, sizes and level, so reruns agree.
Null texts have size 0; documents of size 0 take nothing.  Different rows that
share a doc_id are decided one by one.  Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmill.llm.runtime import BROADCAST_ROWS, WORD, cut, join_small, ranked, uniform

#: Documents or blocks of one fold.
FAN = 64
#: Most rows that one task makes of one row.
CHUNK = 4_096


def size_of(text: Column) -> Column:
    """Number of words; each shrinks to one letter in one pass, so that no array of words is made."""
    letters = F.translate(F.regexp_replace(text, WORD, "w"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def fair_level(weighed: DataFrame) -> float:
    """The level at which weight * level, but ``most`` at the utmost, shares out all sizes of ``weighed(source_size, weight, most)``."""
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("most")
        r = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"), F.sum(full.cast("long")).alias("capped")).first()
        if not r.open or r.capped == capped:
            return level
        level, capped = (r.all - r.held) / r.open, r.capped


def targets(sizes: DataFrame, cap: float = 3.0, period: int = 3) -> DataFrame:
    """source, docs (rows of ``sizes``), source_size, weight and target for ``sizes(source, size, n)``, n rows of one size each."""
    total = cut(sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("source_size")))
    order = F.col("source").asc_nulls_last()
    if total.count() <= BROADCAST_ROWS:
        placed = total.withColumn("rank", F.row_number().over(Window.orderBy(order)) - 1)
    else:
        placed = ranked(total, [order])
    weighed = cut(placed.withColumn("weight", (F.col("rank") % period + 1).cast("int")).withColumn("most", F.lit(float(cap)) * F.col("source_size")).drop("rank"))
    return weighed.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(fair_level(weighed)))).drop("most")


_ITEM = ["doc_id", "h", "size", "n", "ups"]


def _fold(items: Column, level: int) -> Column:
    """Pivotal rounding over one block: the document left undecided, and those decided as up or down.

    Each item has doc_id, h, size, its group's n and ups, and p.  The state
    holds the one undecided so far; a p that has just become 0 or 1 is settled
    by the next step.
    """

    def step(state: Column, x: Column) -> Column:
        a = state["left"]
        up = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])
        down = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])
        grow = uniform(F.lit(level), a["doc_id"], a["h"], x["doc_id"], x["h"]) * (up + down) < down
        moved = F.when(grow, up).otherwise(-down)
        a_done = F.when(grow, up >= (1 - a["p"]) * a["size"]).otherwise(down >= a["p"] * a["size"])
        rest = F.when(a_done, x["p"] - moved / x["size"]).otherwise(a["p"] + moved / a["size"])
        left = F.when(a_done, x).otherwise(a)
        gone = F.when(a_done, a).otherwise(x)
        out = F.struct(*[gone[c].alias(c) for c in _ITEM], (a_done == grow).alias("up"))
        now = F.struct(*[left[c].alias(c) for c in _ITEM], F.least(F.greatest(rest, F.lit(0.0)), F.lit(1.0)).alias("p"))
        return F.struct(now.alias("left"), F.concat(state["done"], F.array(out)).alias("done"))

    none = F.array().cast("array<struct<doc_id:bigint,h:bigint,size:bigint,n:bigint,ups:bigint,up:boolean>>")
    return F.aggregate(F.slice(items, 2, F.size(items)), F.struct(F.element_at(items, 1).alias("left"), none.alias("done")), step)


def rounded(docs: DataFrame, levels: int) -> DataFrame:
    """source, doc_id, h, size, n, ups and up (the undecided one taken or not) for ``docs(source, doc_id, h, size, n, ups, p, block)``.

    ``levels`` must be enough for one block of each source to be left.
    """
    now, out = docs, []
    for level in range(levels):
        # Large documents first: the smaller ones that follow settle them, so that a small one is left.
        items = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), *_ITEM, "p")))
        items = F.transform(items, lambda x: x.dropFields("order"))
        folded = cut(now.groupBy("source", "block").agg(items.alias("items")).select("source", "block", _fold(F.col("items"), level).alias("f")))
        out.append(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.*"))
        now = folded.select("source", F.floor(F.col("block") / FAN).alias("block"), "f.left").select("source", "block", "left.*")
    done = now.select("source", *_ITEM, (F.col("p") >= 0.5).alias("up"))
    for more in out:
        done = done.unionByName(more)
    return done


def decided(docs: DataFrame, cap: float = 3.0, period: int = 3, h: Column | None = None) -> DataFrame:
    """One row for each group of equal rows of ``docs(doc_id, text, source)``: doc_id, h, source, size, source_size, target, n, whole and ups.

    Of a group's n rows each takes ``whole`` copies and ``ups`` of them one
    more.  ``h`` (default: a hash of the three columns) tells rows apart that
    share a doc_id.
    """
    h = F.xxhash64("doc_id", "text", "source") if h is None else h
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    # Equal rows meet in their own task first, so a row that is there a billion times is a few rows of the shuffle.
    groups = cut(sized.groupBy("doc_id", "h", "source", "size").agg(F.count("*").alias("n")))
    quotas = cut(targets(groups.select("source", "size", "n"), cap, period))
    blocks = (quotas.agg(F.max("docs")).first()[0] or 1) / FAN
    levels = 1 + max(0, math.ceil(math.log(max(1, math.ceil(blocks)), FAN)))
    share = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = join_small(groups, quotas, "source", spread=F.col("h")).withColumn("whole", F.floor(share)).withColumn("mass", (share - F.floor(share)) * F.col("n"))
    rows = rows.withColumn("ups", F.floor("mass")).withColumn("p", F.col("mass") - F.floor("mass"))
    block = F.pmod(F.xxhash64(F.lit("block"), "doc_id", "h"), F.ceil(F.col("docs") / FAN))
    keep = ["doc_id", "h", "source", "size", "source_size", "target", "n", "whole", "ups"]
    tree = rounded(rows.where("p > 0").select("source", *_ITEM, "p", block.alias("block")), levels)
    settled = join_small(tree.withColumn("ups", F.col("ups") + F.col("up").cast("long")), quotas, "source", spread=F.col("h")).withColumn("whole", F.floor(share))
    return rows.where("p = 0").select(keep).unionByName(settled.select(keep))


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each of ``rows`` as often as its column ``times`` says, without it; long runs are dealt over tasks."""
    n = F.col(times)
    run = lambda last: F.explode(F.sequence(F.lit(1), last.cast("int")))
    short = rows.where(n.between(1, CHUNK)).withColumn("__k", run(n)).drop("__k", times)
    chunks = rows.where(n > CHUNK).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / CHUNK))))
    chunks = chunks.repartition(F.xxhash64("__chunk")).withColumn("__k", run(F.least(n - F.col("__chunk") * CHUNK, F.lit(CHUNK))))
    return short.unionByName(chunks.drop("__k", "__chunk", times))


def mix(docs: DataFrame, cap: float = 3.0, period: int = 3, h: Column | None = None) -> DataFrame:
    """doc_id, h, source, size, source_size, target and copies, one row for each row of ``docs(doc_id, text, source)``."""
    runs = F.array(F.struct(F.col("ups").alias("times"), (F.col("whole") + 1).alias("copies")), F.struct((F.col("n") - F.col("ups")).alias("times"), F.col("whole").alias("copies")))
    out = decided(docs, cap, period, h).withColumn("r", F.explode(runs)).select("doc_id", "h", "source", "size", "source_size", "target", "r.copies", "r.times")
    return repeated(out, "times")


def op1(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def copied(docs: DataFrame, cap: float = 3.0, period: int = 3) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; rows of size 0 go."""
    h = F.xxhash64(*docs.columns)
    taken = cut(decided(docs, cap, period, h).select(F.col("doc_id").alias("__doc"), F.col("h").alias("__h"), F.col("n").alias("__n"), (F.col("n") * F.col("whole") + F.col("ups")).alias("__copies")).where("__copies > 0"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__own") == F.col("__h"))
    rows = docs.withColumn("__own", h)
    out = repeated(rows.join(taken.where("__n = 1"), same).select(*docs.columns, "__copies"), "__copies")
    alike = taken.where("__n > 1")
    if alike.isEmpty():
        return out
    # Rows alike in every column share their copies; they meet in their own task first.
    more = rows.join(alike, same).groupBy(*docs.columns).agg(F.max("__copies").alias("__copies"))
    return out.unionByName(repeated(more, "__copies"))
