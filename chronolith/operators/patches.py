"""Unified diffs as rows: files, hunks and lines, from texts of a key and a body.

A text is cut into files and these into hunks where their first lines begin, each by one split of a string, so that
files, hunks and lines are rows without a shuffle, a window or a sort. A file begins at ``diff --git``; what stands before its first ``@@`` is
header, what stands after is body, where only the first character of a line counts: a removed line may
itself look like a header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUNK = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@(?: (.*))?$"
SUBMODULE, SYMLINK = "160000", "120000"


def lines_of(texts: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """``key, line_no, text`` without the end of the last line; empty and null bodies have no lines."""
    bare = F.regexp_replace(body, r"\n\z", "")
    return texts.where(F.coalesce(F.col(body), F.lit("")) != "").select(F.col(key).alias("key"), F.posexplode(F.split(bare, "\n")).alias("line_no", "text"))


def _starts(parts: Column) -> Column:
    """The number of lines before each of the parts of a text."""
    sizes = F.transform(parts, lambda p: F.size(F.split(p, "\n")))
    none = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(sizes, none, lambda a, n: F.struct((a["n"] + n).alias("n"), F.concat(a["at"], F.array(a["n"])).alias("at")))["at"]


def sections(texts: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """``key, file_no, first_line, header, hunks``: a row for each file of a text (0 for what stands before the first),
    with its header and the texts of its hunks; empty and null bodies have none.

    In a body, ``diff --git`` and ``@@`` can begin no line of a hunk, as those begin with a sign or a blank.
    """
    bare = F.regexp_replace(body, r"\n\z", "")
    filled = texts.where(F.coalesce(F.col(body), F.lit("")) != "").select(F.col(key).alias("key"), F.split(bare, r"\n(?=diff --git )").alias("parts"))
    whole = filled.select("key", "parts", _starts(F.col("parts")).alias("starts"), F.coalesce(F.col("parts")[0].startswith("diff --git "), F.lit(False)).cast("int").alias("lead"))
    # Outer, though no text is without parts: else the plan filters by the size of the parts, and cuts a text once more for that.
    each = whole.select("key", "lead", "starts", F.posexplode_outer("parts").alias("at", "text"))
    pieces = F.split("text", r"\n(?=@@ -[0-9])")
    cut = each.select("key", (F.col("at") + F.col("lead")).cast("long").alias("file_no"), F.col("starts")[F.col("at")].alias("first_line"), pieces.alias("pieces"))
    headless = F.col("pieces")[0].rlike(r"^@@ -[0-9]")
    header = F.when(~headless, F.col("pieces")[0])
    return cut.select("key", "file_no", "first_line", header.alias("header"), F.when(headless, F.col("pieces")).otherwise(F.slice("pieces", F.lit(2), F.size("pieces"))).alias("hunks"))


def placed(texts: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """Lines with ``file_no``, ``hunk_no`` (0 in a header) and ``kind``."""
    pieces = F.when(F.col("header").isNull(), F.col("hunks")).otherwise(F.concat(F.array("header"), F.col("hunks")))
    parts = sections(texts, key, body).select("key", "file_no", "first_line", F.col("header").isNull().cast("int").alias("lead"), pieces.alias("pieces"))
    each = parts.select("key", "file_no", "first_line", "lead", _starts(F.col("pieces")).alias("starts"), F.posexplode("pieces").alias("at", "piece"))
    lines = each.select("key", "file_no", (F.col("at") + F.col("lead")).cast("long").alias("hunk_no"), (F.col("first_line") + F.col("starts")[F.col("at")]).alias("base"), F.posexplode(F.split("piece", "\n")).alias("n", "text"))
    first = F.substring("text", 1, 1)
    kind = (
        F.when((F.col("hunk_no") == 0) | (F.col("file_no") == 0), "header")
        .when(F.col("n") == 0, "hunk")
        .when(first == "+", "added")
        .when(first == "-", "removed")
        .when(first == "\\", "no_newline")
        .when((first == " ") | (F.col("text") == ""), "context")
        .otherwise("other")
    )
    return lines.select("key", (F.col("base") + F.col("n")).alias("line_no"), "text", "file_no", "hunk_no", kind.alias("kind"))


def changed_lines(rows: DataFrame) -> DataFrame:
    """The lines of hunks without their signs."""
    return rows.where(F.col("kind").isin("added", "removed", "context")).select("key", "file_no", "hunk_no", "line_no", "kind", F.substring(F.col("text"), F.lit(2), F.length("text")).alias("text"))


#: How the lines of each kind begin, behind the line feed before them.
_SIGNS = {"added": r"\n\+", "removed": r"\n-", "no_newline": r"\n\\", "context": r"\n(?=[ \n]|\z)"}


def _number(text: Column, otherwise: int | None = None) -> Column:
    n = F.nullif(text, F.lit("")).try_cast("long")
    return n if otherwise is None else F.coalesce(n, F.lit(otherwise))


def hunks(rows: DataFrame) -> DataFrame:
    """Places and lengths of the hunks, an omitted length being 1, and the lines that they really have.

    ``rows`` are sections, which need no shuffle, or placed lines; so in :func:`files`.
    """
    g = [F.regexp_extract("head", HUNK, k) for k in range(1, 6)]
    counts = ("added", "removed", "context", "no_newline")
    if "hunks" in rows.columns:
        each = rows.where("file_no > 0").select("key", "file_no", F.posexplode("hunks").alias("at", "text"))
        body = F.expr("substring(text, length(head) + 1)")  # with the line feed before each line
        per = each.select("key", "file_no", (F.col("at") + 1).cast("long").alias("hunk_no"), "text", F.substring_index("text", "\n", 1).alias("head")).select("key", "file_no", "hunk_no", "head", *[F.regexp_count(body, F.lit(_SIGNS[k])).cast("long").alias(k) for k in counts])
    else:
        per = rows.where("file_no > 0 and hunk_no > 0").groupBy("key", "file_no", "hunk_no").agg(F.max(F.when(F.col("kind") == "hunk", F.col("text"))).alias("head"), *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in counts])
    out = per.select(
        "key", "file_no", "hunk_no",
        _number(g[0]).alias("old_start"), _number(g[1], 1).alias("old_len"), _number(g[2]).alias("new_start"), _number(g[3], 1).alias("new_len"),
        F.nullif(g[4], F.lit("")).alias("context_of"), *counts,
    )
    whole = (F.col("context") + F.col("removed") == F.col("old_len")) & (F.col("context") + F.col("added") == F.col("new_len"))
    return out.withColumn("reconciles", whole)


#: What the lines of a file's header say, each line one thing: pattern of the whole line, and the fields of its groups.
HEADERS = (
    (r"^diff --git a/(.*) b/(.*)$", ("git_a", "git_b")),
    (r"^--- a/(.*?)\t?$", ("minus",)),
    (r"^\+\+\+ b/(.*?)\t?$", ("plus",)),
    (r"^rename from (.*)$", ("rename_from",)),
    (r"^rename to (.*)$", ("rename_to",)),
    (r"^similarity index ([0-9]+)%$", ("similarity",)),
    (r"^new file mode ([0-9]+)$", ("new_mode",)),
    (r"^deleted file mode ([0-9]+)$", ("deleted_mode",)),
    (r"^new mode ([0-9]+)$", ("changed_mode",)),
    (r"^index ([0-9a-f]+)\.\.([0-9a-f]+)(?: ([0-9]+))?$", ("old_blob", "new_blob", "index_mode")),
    (r"^(Binary files .* differ|GIT binary patch)$", ("binary",)),
)


def files(rows: DataFrame) -> DataFrame:
    """One row per file of a diff: paths, status, similarity, mode, blob ids, and its added and removed lines.

    Only headers are read with patterns; a file keeps the first value of a field.
    """
    if "hunks" in rows.columns:
        body = F.array_join(F.transform("hunks", lambda h: F.regexp_replace(h, r"\A[^\n]*", "")), "")
        shown = rows.where("file_no > 0").select("key", "file_no", "header", F.size("hunks").cast("long").alias("hunks"), body.alias("body"))
        counted = shown.select("key", "file_no", "header", "hunks", *[F.regexp_count("body", F.lit(_SIGNS[k])).cast("long").alias(n) for k, n in (("added", "additions"), ("removed", "deletions"), ("no_newline", "no_newline"))])
        fields = {f: F.nullif(F.regexp_extract("header", "(?dm)" + p, g), F.lit("")) for p, names in HEADERS for g, f in enumerate(names, 1)}
    else:
        kind, text = F.col("kind"), F.col("text")
        counted = rows.where("file_no > 0").groupBy("key", "file_no").agg(
            F.count_if(kind == "added").alias("additions"), F.count_if(kind == "removed").alias("deletions"), F.count_if(kind == "no_newline").alias("no_newline"), F.max("hunk_no").alias("hunks"),
            *[F.min(F.when(kind == "header", F.when(text.rlike(p), F.struct("line_no", text.alias("t"))))).alias(f"_h{k}") for k, (p, _) in enumerate(HEADERS)],
        )
        fields = {f: F.nullif(F.regexp_extract(F.col(f"_h{k}")["t"], p, g), F.lit("")) for k, (p, names) in enumerate(HEADERS) for g, f in enumerate(names, 1)}
    per = counted.select("*", *[c.alias(f) for f, c in fields.items()]).withColumn("is_binary", F.col("binary").isNotNull())
    status = F.when(F.col("new_mode").isNotNull(), "added").when(F.col("deleted_mode").isNotNull(), "removed").when(F.col("rename_to").isNotNull(), "renamed").otherwise("modified")
    mode = F.coalesce("new_mode", "deleted_mode", "changed_mode", "index_mode")
    return per.select(
        "key", "file_no",
        F.when(status != "added", F.coalesce("rename_from", "minus", "git_a")).alias("old_path"),
        F.when(status != "removed", F.coalesce("rename_to", "plus", "git_b")).alias("new_path"),
        status.alias("status"), F.col("similarity").try_cast("int").alias("similarity"), mode.alias("mode"),
        F.coalesce(mode == SUBMODULE, F.lit(False)).alias("is_submodule"), F.coalesce(mode == SYMLINK, F.lit(False)).alias("is_symlink"),
        "is_binary", "old_blob", "new_blob", "additions", "deletions", "no_newline", "hunks",
    )


def entry_stats(per_file: DataFrame) -> DataFrame:
    """``key, stats, files`` of every diff, in the shape of a change record."""
    path = F.coalesce("new_path", "old_path")
    by = {k: F.array_sort(F.collect_list(F.when(F.col("status") == k, path))).alias(k) for k in ("added", "removed", "renamed", "modified")}
    agg = per_file.groupBy("key").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count("file_no").alias("total"), *by.values())
    return agg.select("key", F.struct("additions", "deletions").alias("stats"), F.struct("total", *by).alias("files"))


def version_bumps(rows: DataFrame) -> DataFrame:
    """``key, file_no, hunk_no, old, new`` of hunks that replace one ``"version"`` by another (this library's rule)."""
    version = r'^[-+]\s*"version"\s*:\s*"([^"]+)"'
    seen = rows.where(F.col("kind").isin("added", "removed") & F.col("text").rlike(version)).withColumn("v", F.regexp_extract("text", version, 1))
    per = seen.groupBy("key", "file_no", "hunk_no").agg(F.min_by("v", F.when(F.col("kind") == "removed", F.col("line_no"))).alias("old"), F.min_by("v", F.when(F.col("kind") == "added", F.col("line_no"))).alias("new"))
    return per.where("old is not null and new is not null and old != new")


#: What a line states: pattern, whose first group is the name and whose second is the value. The patterns are this library's.
FACTS = {
    "constant": r"\b(?:const|let|static|final)\s+([A-Z][A-Z0-9_]+)\s*(?::[^=]+)?=\s*(.+?);?\s*$",
    "env": r"\b(?:process\.env\.|os\.environ\[.|getenv\(.)([A-Z][A-Z0-9_]+)()",
    "flag": r"""['"](--[a-z][a-z0-9-]+)['"]()""",
    "export": r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|interface|type|enum)\s+([A-Za-z_$][\w$]*)()",
    "test": r"""\b(?:it|test|describe)\(\s*['"`](.+?)['"`]()""",
}


def _stated(text: Column) -> Column:
    """The facts of a line, each with its name and value."""
    found = F.array(*[F.when(text.rlike(p), F.struct(F.lit(k).alias("fact"), F.regexp_extract(text, p, 1).alias("name"), F.regexp_extract(text, p, 2).alias("value"))) for k, p in FACTS.items()])
    return F.array_compact(found)


def facts(rows: DataFrame) -> DataFrame:
    """``key, file_no, fact, name, old, new``: constants, environment variables, flags, exports and test titles that
    lines add or remove, whatever stands elsewhere (see :func:`fact_changes`)."""
    body = changed_lines(rows).where("kind != 'context'")
    each = body.select("key", "file_no", "kind", F.explode(_stated(F.col("text"))).alias("f")).select("key", "file_no", "kind", "f.*")
    side = lambda k: F.max(F.when(F.col("kind") == k, F.col("value")))
    return each.groupBy("key", "file_no", "fact", "name").agg(side("removed").alias("old"), side("added").alias("new")).where("not (old <=> new)")


def images(cut: DataFrame) -> DataFrame:
    """``key, file_no, hunk_no, old_start, old_len, before, after``: the lines of each hunk as they were and as they are."""
    each = cut.where("file_no > 0").select("key", "file_no", F.posexplode("hunks").alias("at", "text"))
    head, lines = F.substring_index("text", "\n", 1), F.split("text", "\n")
    body = F.slice(lines, F.lit(2), F.size(lines))
    side = lambda sign: F.transform(F.filter(body, lambda x: (x == "") | F.substring(x, 1, 1).isin(" ", sign)), lambda x: F.substring(x, F.lit(2), F.length(x)))
    place = lambda g, otherwise: _number(F.regexp_extract(head, HUNK, g), otherwise)
    return each.select("key", "file_no", (F.col("at") + 1).cast("long").alias("hunk_no"), place(1, None).alias("old_start"), place(2, 1).alias("old_len"), side("-").alias("before"), side("+").alias("after"))


def applied(cut: DataFrame, base: DataFrame) -> DataFrame:
    """``key, file_no, path, text``: the files of ``base`` (path, text) after a diff, for those that it names; null where a
    hunk does not fit what the file holds at its place.

    A file is one row, and its hunks one array, folded from the first to the last.
    """
    named = files(cut).where("status in ('modified', 'renamed')").select("key", "file_no", F.col("old_path").alias("path"))
    hunk = F.struct("hunk_no", "old_start", "old_len", "before", "after")
    per = images(cut).groupBy("key", "file_no").agg(F.array_sort(F.collect_list(hunk)).alias("hunks"))
    held = named.join(per, ["key", "file_no"]).join(base.select("path", F.col("text").alias("_text")), "path").withColumn("_lines", F.split("_text", "\n"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"), F.lit(True).alias("fits"))

    def put(state: Column, h: Column) -> Column:
        # A hunk without old lines stands after the line that it names.
        first = F.when(h["old_len"] == 0, h["old_start"]).otherwise(h["old_start"] - 1)
        ahead = F.slice("_lines", (state["at"] + 1).cast("int"), F.greatest(first - state["at"], F.lit(0)).cast("int"))
        there = F.slice("_lines", (first + 1).cast("int"), h["old_len"].cast("int"))
        fits = state["fits"] & (first >= state["at"]) & (there == h["before"])
        return F.struct((first + h["old_len"]).alias("at"), F.concat(state["out"], ahead, h["after"]).alias("out"), F.coalesce(fits, F.lit(False)).alias("fits"))

    done = held.withColumn("_done", F.aggregate("hunks", start, put))
    rest = F.slice("_lines", (F.col("_done.at") + 1).cast("int"), F.size("_lines"))
    return done.select("key", "file_no", "path", F.when(F.col("_done.fits"), F.array_join(F.concat("_done.out", rest), "\n")).alias("text"))


def _path(header: Column) -> Column:
    """The path of a file before the change, or after it where there was none, as in :func:`files`."""
    begins = {"rename_from": "rename from ", "rename_to": "rename to ", "new_mode": "new file mode "}  # looked for first, as most headers have none
    field = {f: F.nullif(F.regexp_extract(header, "(?dm)" + p, g), F.lit("")) for p, names in HEADERS for g, f in enumerate(names, 1)}
    field |= {f: F.when(header.contains(begin), field[f]) for f, begin in begins.items()}
    old = F.coalesce(field["rename_from"], field["minus"], field["git_a"])
    return F.coalesce(F.when(field["new_mode"].isNull(), old), field["rename_to"], field["plus"], field["git_b"])


def fact_changes(cut: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``key, fact, name, old, new``: what a diff states anew or no more, pruned by what was there before.

    A fact of the lines after a change counts only if no line before it, in any file of the diff, states the same name and
    value, so that what is moved gives none; with ``base`` (path, text: the files before the change) nor may the base of its
    own file, of which a diff shows a part. ``old`` is what the lines before state of the name, if it is gone after.
    Diffs are read once: each line's facts go to the side or sides that it stands on, meet the base by path and fact, and
    then those of their own name, so a diff with very many facts is many groups.
    """
    fact = ["fact", "name", "value"]
    shown = cut.where("file_no > 0").select("key", _path(F.col("header")).alias("path"), F.explode_outer("hunks").alias("hunk"))
    lines = shown.select("key", "path", F.posexplode(F.split("hunk", "\n")).alias("at", "line")).where(F.col("at") > 0)
    sign = F.substring("line", 1, 1)
    signed = lines.where(sign.isin(" ", "-", "+")).select("key", "path", (sign != "+").alias("_before"), (sign != "-").alias("_after"), F.substring(F.col("line"), F.lit(2), F.length("line")).alias("line"))
    stated = lambda df, *keep: df.select(*keep, F.explode(_stated(F.col("line"))).alias("f")).select(*keep, "f.*")
    each = stated(signed, "key", "path", "_before", "_after").withColumn("_fresh", F.col("_after"))
    if base is not None:
        held = stated(base.select("path", F.explode(F.split("text", "\n")).alias("line")), "path").distinct().withColumn("_held", F.lit(True))
        each = each.join(held, ["path", *fact], "left").withColumn("_fresh", F.col("_after") & F.col("_held").isNull())
    # Dealt by name once, which serves both groupings.
    dealt = each.select("key", *fact, "_before", "_after", "_fresh").repartition("key", "fact", "name")
    values = dealt.groupBy("key", *fact).agg(*[F.bool_or(c).alias(c) for c in ("_before", "_after", "_fresh")])
    new, gone = F.col("_fresh") & ~F.col("_before"), F.col("_before") & ~F.col("_after")
    side = lambda which: F.max(F.when(which, F.col("value")))
    return values.where(new | gone).groupBy("key", "fact", "name").agg(side(gone).alias("old"), side(new).alias("new"))
