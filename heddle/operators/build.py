"""Building the lineage graph: nodes from respondents, listed children and curated rows; edges from resolved text,
listings and curated links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle import functions as H

from .describe import child_sequence
from .graph import union_edges
from .match import cascade, unique_keys


def build(respondents: DataFrame, listings: DataFrame, curated: DataFrame, resolved: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). respondents and curated have node, name, email; listings src, name, email; resolved and links
    src, dst.

    A listed child is the respondent with its e-mail, else the one respondent of its name; otherwise a node of its
    own, one for all who list the same e-mail (or, without one, the same name), numbered under the least of them.
    Curated rows with a respondent's e-mail are that respondent. Edge types: advisor, listing, manual.
    """
    key = F.coalesce(F.nullif(H.norm_email("email"), F.lit("")), H.norm_person("name"))
    people = respondents.select("node", "name", H.norm_email("email").alias("mail"), H.norm_person("name").alias("person"))
    listed = listings.select("src", "name", H.norm_email("email").alias("mail"), H.norm_person("name").alias("person"), key.alias("key")).where("key <> ''")
    mails, _ = unique_keys(people.where("mail <> ''"), "mail", "node")
    names, _ = unique_keys(people.where("person <> ''"), "person", "node")
    by_mail = listed.join(mails, "mail").groupBy("key").agg(F.min("node").alias("match"))
    by_name = listed.where("mail = ''").join(names, "person").groupBy("key").agg(F.min("node").alias("match"))
    known = cascade(listed, "key", [("email", by_mail), ("name", by_name)]).select("key", "match")
    fresh = listed.join(known.where("match is null"), "key", "left_semi").groupBy("key").agg(F.min("src").alias("src"), F.min("name").alias("name"), F.min("mail").alias("email"))
    fresh = child_sequence(fresh, "src", ["key"]).select("key", F.col("child_id").alias("node"), "name", "email")
    ids = known.join(fresh.select("key", "node"), "key", "left").select("key", F.coalesce("match", "node").alias("dst"))
    other = curated.select("node", "name", H.norm_email("email").alias("email")).join(mails.select(F.col("mail").alias("email"), F.col("node").alias("same")), "email", "left")
    nodes = respondents.select("node", "name", H.norm_email("email").alias("email"), F.lit("respondent").alias("source"))
    nodes = nodes.unionByName(fresh.select("node", "name", "email", F.lit("listing").alias("source"))).unionByName(other.where("same is null").select("node", "name", "email", F.lit("curated").alias("source")))
    real = other.where("same is not null").select(F.col("node").alias("dst"), "same")
    manual = links.join(real, "dst", "left").select("src", F.coalesce("same", "dst").alias("dst"), F.lit("manual").alias("type"), F.lit("high").alias("confidence"))
    told = resolved.select("src", "dst", F.lit("advisor").alias("type"), F.lit("high").alias("confidence"))
    given = listed.select("src", "key").distinct().join(ids, "key").select("src", "dst", F.lit("listing").alias("type"), F.lit("high").alias("confidence"))
    return nodes, union_edges(told, given, manual)
