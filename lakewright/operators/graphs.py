"""Trees, paths and link graphs by doubling and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_links, wikilinks
from .identity import keep_rounds
from .stored import stored


def paths(spark, nodes: str, id_: str, parent: str, label: str) -> DataFrame:
    """(id, depth, path) from each root, over a view; a cycle ends at its first repeated node.

    Each round doubles the length of the walks that do not start at a root and hangs them below the
    paths found so far, so any depth ends after logarithmically many rounds. Rounds are checkpointed.
    """
    keep_rounds(spark)
    rows = spark.table(nodes).select(F.col(parent).alias("top"), F.col(id_).alias("id"), F.array(F.col(id_)).alias("seen"), F.col(label).cast("string").alias("path"))
    whole = rows.where("top is null").select("id", "seen", "path").checkpoint()
    walks = rows.where("top is not null").checkpoint()

    def below(upper: DataFrame, lower: DataFrame, *top: str) -> DataFrame:
        lower = lower.select(F.col("top").alias("_top"), F.col("id").alias("_id"), F.col("seen").alias("_seen"), F.col("path").alias("_path"))
        met = upper.join(lower, F.col("id") == F.col("_top")).where("not arrays_overlap(seen, _seen)")
        return met.select(*top, F.col("_id").alias("id"), F.concat("seen", "_seen").alias("seen"), F.concat("path", F.lit("/"), "_path").alias("path"))

    while not walks.isEmpty():
        whole, walks = whole.union(below(whole, walks)).checkpoint(), below(walks, walks, "top").checkpoint()
    return whole.select("id", (F.size("seen") - 1).alias("depth"), "path")


def thread_roots(spark, messages: str, id_: str, parent: str) -> DataFrame:
    """(id, root): follows parents to the last known one; in a cycle the smallest id met.

    Pointers jump to their pointer's pointer, so any length ends after logarithmically many rounds;
    each knows the smallest id it passed. A round that ends no chain leaves only those that run into a
    cycle, and these are done when they have walked as many steps as there are such messages. Of
    repeated ids the smallest parent counts. Messages without id have no thread. Rounds are checkpointed.
    """
    keep_rounds(spark)
    rows = spark.table(messages).select(F.col(id_).alias("id"), F.col(parent).alias("parent")).where("id is not null")
    rows = rows.groupBy("id").agg(F.min("parent").alias("parent")).checkpoint()
    known = rows.select(F.col("id").alias("parent"), F.col("id").alias("up"))
    at = F.coalesce("up", "id")
    now = rows.join(known, "parent", "left").select("id", at.alias("at"), F.least("id", at).alias("low"), (at == F.col("id")).alias("done")).checkpoint()
    # a message that answers itself is its own root, as is one whose parent is not known
    steps, left, before = 1, now.where("not done").count(), None
    while left and (left != before or steps < left):
        to = now.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("low").alias("_low"), F.col("done").alias("_done"))
        jumped = now.where("not done").join(to, "at").select("id", F.col("_at").alias("at"), F.least("low", "_low").alias("low"), F.col("_done").alias("done"))
        now = now.where("done").union(jumped).checkpoint()
        steps, before, left = 2 * steps, left, now.where("not done").count()
    return now.select("id", F.when(F.col("done"), F.col("at")).otherwise(F.col("low")).alias("root"))


def reply_parents(messages: DataFrame, id_: str, message_id: str, in_reply_to: str, references: str) -> DataFrame:
    """(id, parent): the first of a message's In-Reply-To ids, then of its References from the last one back, that another message bears.

    Of messages with one Message-ID the last by id counts. Ids that nobody bears, or only the message itself, are passed over. Null where none is left.
    """
    known = messages.where(F.col(message_id).isNotNull()).groupBy(F.col(message_id).alias("named")).agg(F.max(id_).alias("parent"))
    none = F.array().cast("array<string>")
    said = F.concat(F.coalesce(F.col(in_reply_to), none), F.reverse(F.coalesce(F.col(references), none)))
    rows = messages.select(F.col(id_).alias("id"), F.posexplode(said).alias("at", "named"))
    found = rows.join(known, "named").where("parent <> id").groupBy("id").agg(F.min_by("parent", "at").alias("parent"))
    return messages.select(F.col(id_).alias("id")).join(found, "id", "left").select("id", "parent")


def mail_threads(messages: DataFrame, id_: str, message_id: str, in_reply_to: str, references: str) -> DataFrame:
    """(id, parent, root, thread): threads by reply headers; thread is a name made of the root's id."""
    parents = stored(reply_parents(messages, id_, message_id, in_reply_to, references), "mail-parents")
    name = f"lw_mail_{uuid.uuid4().hex[:12]}"
    parents.createOrReplaceTempView(name)
    roots = thread_roots(messages.sparkSession, name, "id", "parent")
    messages.sparkSession.catalog.dropTempView(name)
    return parents.join(roots, "id").select("id", "parent", "root", F.concat(F.lit("thread-"), F.substring(F.sha2(F.col("root").cast("string").cast("binary"), 256), 1, 16)).alias("thread"))


def links(pages: DataFrame, id_: str, html: str) -> DataFrame:
    return pages.select(F.col(id_).alias("src"), F.explode(html_links(F.col(html))).alias("target"))


def note_links(notes: DataFrame, id_: str, text: str) -> DataFrame:
    return notes.select(F.col(id_).alias("src"), F.explode(wikilinks(F.col(text))).alias("target"))


def resolve(links: DataFrame, index: DataFrame) -> DataFrame:
    """(src, target, found, state). index: (key, id, tier). The lowest tier with a hit decides; several hits there are ambiguous."""
    hit = links.join(index.withColumn("_k", F.lower("key")), F.lower(links["target"]) == F.col("_k"), "left")
    tier = hit.groupBy("src", "target").agg(F.min("tier").alias("best"))
    ids = hit.join(tier, ["src", "target"]).where("tier = best").groupBy("src", "target").agg(F.collect_set("id").alias("ids"))
    out = tier.join(ids, ["src", "target"], "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    return out.select("src", "target", F.when(n == 1, F.col("ids")[0]).alias("found"), F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("state"))


def without_incoming(nodes: DataFrame, id_: str, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias(id_)).distinct(), id_, "left_anti")
