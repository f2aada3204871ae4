"""Legal texts: article mentions, headings, amendment lists, pages, and versions of a norm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import shuffle_partitions
from . import ranks

#: "artículo 5", "artículos 5, 6 y 7", "art. 5"; group 1 holds the list of numbers.
MENTION = r"(?i)\bart(?:[ií]culos?|s?\.)\s+(\d+(?:\.\d+)*(?:(?:\s*,\s*|\s+y\s+|\s*,?\s+e\s+)\d+(?:\.\d+)*)*)"
HEADING = r"(?i)^\s*art[ií]culo\s+(\d+)\s*[.\-°º]*\s*(\S.*)?$"


def mentioned(text: Column, most: int) -> Column:
    """Sorted distinct article numbers that a text mentions, single or in lists, from 1 to ``most``."""
    lists = F.regexp_extract_all(text, F.lit(MENTION), F.lit(1))
    numbers = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)(?:\.\d+)*"), F.lit(1))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(numbers, lambda x: x.cast("int")), lambda n: n.between(1, most))))


def heading(line: Column) -> Column:
    """Struct (article, title) of a line that opens an article; null for other lines."""
    number = F.regexp_extract(line, HEADING, 1)
    title = F.nullif(F.trim(F.regexp_extract(line, HEADING, 2)), F.lit(""))
    return F.when(number != "", F.struct(number.cast("int").alias("article"), title.alias("title")))


def amendment_items(text: Column) -> Column:
    """Items of an amendment list: parted by ``;`` and by a ``y`` before a number, without blanks."""
    parts = F.split(F.regexp_replace(text, r"\s+y\s+(?=\d)", ";"), r"\s*;\s*")
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"[.\s]+$", ""))), lambda x: x != "")


def page_of(offset: Column, ends: Column) -> Column:
    """The number, from 1, of the page that holds a character, by the running ends of pages."""
    return F.size(F.filter(ends, lambda e: e <= offset)) + 1


def with_pages(marks: DataFrame, pages: DataFrame, key: str, offset: str, size: str, page: str) -> DataFrame:
    """Each mark with the page of its document whose characters hold it, an as-of join by position.

    Marks and the begins of pages are sorted together, so a document is read once, in order.
    """
    w = Window.partitionBy(key).orderBy(page)
    begins = pages.select(key, (F.sum(size).over(w) - F.col(size)).alias("__at"), F.col(page).alias("__page"), F.lit(0).alias("__mark"))
    both = begins.unionByName(marks.withColumns({"__at": F.col(offset).cast("long"), "__mark": F.lit(1)}), allowMissingColumns=True)
    held = Window.partitionBy(key).orderBy("__at", "__mark", F.col("__page").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("page_found", F.last_value("__page", True).over(held)).where("__mark = 1").select(*marks.columns, "page_found")


def two_way(hits: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """For each hit the changes of its article, and for each change the original it changes.

    ``hits`` (hit_id, article, is_change); ``changes`` (change_id, article, and ``order``'s columns).
    """
    originals, amending = hits.where("not is_change").select("hit_id", "article"), hits.where("is_change").select("hit_id", "article")
    onward = _sharing(originals, changes.select(F.col("change_id").alias("other_id"), "article")).withColumn("relation", F.lit("amended_by"))
    back = _sharing(amending, originals.withColumnRenamed("hit_id", "other_id")).withColumn("relation", F.lit("amends"))
    return onward.unionByName(back)


#: Rows of a block at most, about, of those that meet by article.
MEETING = 65_536


def _sharing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (hit_id, other_id) of ``left`` (hit_id, article) and ``right`` (other_id, article) that share an article, once each.

    There may be as many pairs as the product of both, so pairs are never held or compared: each side's
    articles are gathered by id, and a pair counts at the least article that both have.  Blocks of
    one side meet blocks of the other, so that a frequent article is no single task.
    """
    sets = lambda df, key, held: df.where("article is not null").groupBy(key).agg(F.collect_set("article").alias("articles")).select(
        key, F.when(F.size("articles") > 1, F.col("articles")).alias(held), F.explode("articles").alias("article"))
    spark, keys = left.sparkSession, ["part", "block", "article"]
    parts, blocks = max(1, -(-left.count() // MEETING)), max(1, -(-right.count() // MEETING))
    tasks = max(shuffle_partitions(spark), min(8 * parts * blocks, 4096))
    dealt = lambda df, key, own, n, other, m: df.withColumns({own: F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))}).repartition(tasks, *keys)
    first = dealt(sets(left, "hit_id", "__a"), "hit_id", "part", parts, "block", blocks)
    second = dealt(sets(right, "other_id", "__b"), "other_id", "block", blocks, "part", parts)
    least = F.col("__a").isNull() | F.col("__b").isNull() | (F.col("article") == F.array_min(F.array_intersect("__a", "__b")))
    return first.join(second.hint("merge"), keys).where(least).select("hit_id", "other_id")


def forced_versions(found: DataFrame, changes: DataFrame, originals: DataFrame, most_changes: int, most_originals: int) -> DataFrame:
    """Fragments that a context must have beside those found: (query_id, relation, position, other_id, article).

    ``found`` (query_id, rank, hit_id, is_change, article, title, mentions) are the ranked fragments of each
    question: the article and title that a fragment itself is, and the articles that it mentions.
    ``changes`` (change_id, article, own, score) say which fragments change an article, and whether one
    is that article itself; ``originals`` (original_id, article, title, score) are all fragments before the change.

    An article that is changed is marked where a rule mentions it or a change is it.  A marked
    article whose change wasn't found asks for its changes, its own fragment first, then by score: the
    best of every article come before the second of any, ``most_changes`` in all.  One whose change was found, and
    whose original wasn't, asks for originals of its number or of the change's title, which are two equality
    joins under one cap of ``most_originals`` with the first article first.  Fragments found, or forced
    once, don't come again; of equal scores the smaller id is first.
    """
    amended = changes.where("article is not null").select("article").distinct()
    named = found.where("is_change and article is not null").select("query_id", "rank", "article", "title", F.lit(True).alias("own"))
    mentioned = found.where("not is_change").select("query_id", "rank", F.explode("mentions").alias("article"), F.lit(None).cast("string").alias("title"), F.lit(False).alias("own"))
    held = found.where("not is_change and article is not null").select("query_id", "article", F.lit(True).alias("__original")).distinct()
    marked = named.unionByName(mentioned).join(amended, "article", "left_semi").groupBy("query_id", "article").agg(
        F.min(F.struct("rank", "article")).alias("first"), F.max("own").alias("changed"), F.min_by("title", F.when(F.col("own"), F.col("rank"))).alias("title"))
    marked = marked.join(held, ["query_id", "article"], "left")
    seen = found.select("query_id", F.col("hit_id").alias("other_id")).distinct()

    def capped(offers: DataFrame, relation: str, most: int, in_turns: bool) -> DataFrame:
        # a fragment that several articles offer counts for the first that would take it
        fresh = offers.join(seen, ["query_id", "other_id"], "left_anti")
        best = F.struct((~F.col("own")).alias("later"), (-F.col("score")).alias("worse"), "other_id")
        turn = F.row_number().over(Window.partitionBy("query_id", "article").orderBy(best))
        few = fresh.withColumn("turn", turn).where(F.col("turn") <= 2 * most)
        order = F.struct("turn", "first") if in_turns else F.struct("first", "turn")
        once = few.groupBy("query_id", "other_id").agg(F.min_by("article", order).alias("article"), F.min(order).alias("place"))
        position = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "other_id"))
        return once.withColumn("position", position).where(F.col("position") <= most).select("query_id", F.lit(relation).alias("relation"), "position", "other_id", "article")

    onward = marked.where("not changed").join(changes, "article").select("query_id", "article", "first", F.col("change_id").alias("other_id"), "own", "score")
    back = marked.where("changed and __original is null").select("query_id", "article", "first", "title")
    by_number = back.drop("title").join(originals.select("article", "original_id", "score"), "article")
    by_title = back.where("title is not null").join(originals.select("title", "original_id", "score"), "title").drop("title")
    either = by_number.unionByName(by_title).select("query_id", "article", "first", F.col("original_id").alias("other_id"), F.lit(False).alias("own"), "score").distinct()
    return capped(onward, "change", most_changes, True).unionByName(capped(either, "original", most_originals, False))


def context_order(is_change: Column, forced: Column) -> list[Column]:
    """Sort keys of a context: changes first, then originals that were forced in, then the rest."""
    return [F.when(is_change, 0).when(forced, 1).otherwise(2)]


def cited(hits: DataFrame, citations: DataFrame, keys: list[str], aliases: dict[str, str], name: str) -> DataFrame:
    """Hits with ``cited``: whether their name and page are among the citations, names by alias."""
    plain = lambda c: F.coalesce(*[F.when(F.lower(F.trim(c)) == a, F.lit(b)) for a, b in aliases.items()], F.lower(F.trim(c)))
    marks = citations.withColumn(name, plain(F.col(name))).select(name, *keys).distinct().withColumn("__hit", F.lit(True))
    return hits.withColumn("__name", plain(F.col(name))).join(marks.withColumnRenamed(name, "__name"), ["__name", *keys], "left").withColumn("cited", F.coalesce("__hit", F.lit(False))).drop("__name", "__hit")


def covered(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Every article with whether a chosen page holds it."""
    held = pages.select("article").distinct().withColumn("__held", F.lit(True))
    return articles.join(held, "article", "left").select("article", F.coalesce("__held", F.lit(False)).alias("covered"))


def selected_pages(pages: DataFrame, document: str, page: str, score: str, mandatory: str, budget: int) -> DataFrame:
    """Pages for a budget: mandatory ones first, then the best scores; of equals the earlier page.

    ``chosen`` and ``reason`` (mandatory, score, rejected), and ``rank`` among the optional ones.
    """
    needed = pages.groupBy(document).agg(F.count_if(mandatory).alias("__needed"))
    placed = ranks.ranked(pages, [document, mandatory], -F.col(score), [F.col(page)], "__place")
    rows = placed.join(needed, document).withColumn("rank", F.when(~F.col(mandatory), F.col("__place"))).drop("__place")
    free = F.greatest(F.lit(0), F.lit(budget) - F.col("__needed"))
    reason = F.when(F.col(mandatory), "mandatory").when(F.col("rank") <= free, "score").otherwise("rejected")
    return rows.withColumn("reason", reason).withColumn("chosen", F.col("reason") != "rejected").drop("__needed")
