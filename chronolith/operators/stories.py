"""Which changes of a day belong together: dated evidence beside a peer's plain words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes that are spelled out.
COUNTRIES = {"SG": "Singapore", "IL": "Israel"}
CLAIM = r"^(.*?\bleft (?:full )?access)((?: on [0-9]{4}-[0-9]{2}-[0-9]{2})?)(?:\.|:|$)"
NOT_A_CLAIM = r"(?i)\b(?:not|never|no longer|if|unless|would|could|might|may|tests?)\b"
GENERIC = r"(?i)(?:^|/)(?:readme[^/]*|package-lock\.json|yarn\.lock|[^/]*\.lock|pnpm-lock\.yaml)$|(?:^|/)(?:tests?|__tests__)/|\.(?:test|spec)\.[^/]+$"


def evidence_of(fact: Column) -> Column:
    """A statement that access was left, with the date only if the fact has one; else empty."""
    stated = F.concat(F.regexp_extract(fact, CLAIM, 1), F.regexp_extract(fact, CLAIM, 2))
    for code, name in COUNTRIES.items():
        stated = F.regexp_replace(stated, rf"\b{code}\b", name)
    return F.when(fact.rlike(CLAIM) & ~fact.rlike(NOT_A_CLAIM), F.concat(stated, F.lit("."))).otherwise(F.lit(""))


def access_evidence(facts: Column) -> Column:
    """The first evidence among the facts of a record, empty if there is none."""
    found = F.filter(F.transform(facts, evidence_of), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def touched(files: Column) -> Column:
    parts = [F.coalesce(files[k], F.array().cast("array<string>")) for k in ("added", "removed", "renamed", "modified")]
    return F.array_distinct(F.concat(*parts))


#: Records that touch one file on one day, from which on both sides of the join are salted.
HOT = 1000


def link(left: DataFrame, right: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs of records of one day that touch the same file: day, sha, peer.

    Both sides have day, sha and path, exploded and without generic paths, so this is an equi-join with the day and the
    path as keys. A key with more than ``hot`` records on both sides is cut into salts: its rows on the left are dealt to
    about one salt for every ``hot`` of them, and those on the right are copied to each, so that no task joins more than
    some ``hot`` rows of the left with a key's right side. Pairs that share more than one file come out once.
    """
    left, right = left.select("day", "path", "sha"), right.select("day", "path", F.col("sha").alias("peer"))
    count = lambda side, name: side.groupBy("day", "path").agg(F.count(F.lit(1)).alias(name))
    sizes = count(left, "l").where(F.col("l") > hot).join(count(right, "r").where(F.col("r") > hot), ["day", "path"])
    heavy = sizes.select("day", "path", F.ceil(F.col("l") / hot).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    dealt = left.join(heavy, ["day", "path"], "left").withColumn("salt", F.pmod(F.xxhash64("sha"), salts).cast("int")).drop("salts")
    copied = right.join(heavy, ["day", "path"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    pairs = dealt.join(copied, ["day", "path", "salt"]).where(F.col("sha") != F.col("peer")).select("day", "sha", "peer")
    return pairs.distinct()


def story_notes(entries: DataFrame) -> DataFrame:
    """``sha, day, peer, text``: for each record with evidence, the peers of its day that share a file.

    Noise, peers without words and peers with evidence of their own give no note; nor do generic files.
    """
    seen = entries.where(~F.coalesce("noise", F.lit(False))).withColumn("evidence", access_evidence(F.col("facts")))
    paths = seen.select("day", "sha", "evidence", F.col("eli5.text").alias("words"), F.explode(touched(F.col("files"))).alias("path")).where(~F.col("path").rlike(GENERIC))
    told = paths.where("evidence != ''")
    peers = paths.where("evidence = '' and coalesce(words, '') != ''")
    pairs = link(told.select("day", "sha", "path"), peers.select("day", "sha", "path"))
    texts = seen.select(F.col("sha").alias("peer"), F.col("eli5.text").alias("words"))
    claims = seen.select("sha", "evidence")
    return pairs.join(claims, "sha").join(texts, "peer").select("sha", "day", "peer", F.concat_ws(" ", "evidence", "words").alias("text"))


def day_leads(entries: DataFrame, notes: DataFrame) -> DataFrame:
    """``day, headline``: the evidence of the first record of the day that has a note, by date and sha."""
    claimed = entries.join(notes.select("sha").distinct(), "sha", "left_semi").withColumn("headline", access_evidence(F.col("facts")))
    return claimed.groupBy("day").agg(F.min_by("headline", F.struct("date", "sha")).alias("headline"))


def announcement(entries: DataFrame, notes: DataFrame, *, plain: bool = False, most: int = 2000) -> DataFrame:
    """``sha, announcement``: title, notes and words of a record, cut at ``most`` characters as a whole. A long title makes room for the notes."""
    lines = notes.groupBy("sha").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("notes"))
    room = F.lit(most - 5) - F.coalesce(F.char_length("notes"), F.lit(0))
    title = F.substring(F.coalesce("title", F.lit("")), F.lit(1), F.greatest(room, F.lit(0)))
    head = title if plain else F.concat(F.lit("**"), title, F.lit("**"))
    text = F.concat_ws("\n", head, "notes", F.col("eli5.text"))
    return entries.join(lines, "sha", "left").select("sha", F.substring(text, 1, most).alias("announcement"))
