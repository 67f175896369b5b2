"""Secret scans: base patterns, and weak candidates linked with the parts that complete them. Column expressions and joins only.

Positions are code points. All matches of a pattern are taken from left to right without overlap: the pieces between the
matches and the matches themselves alternate, so running sums of their lengths give every start. Each text is scanned once: what the
patterns found is written beside the row, and all that follows reads that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.llm.shared import fresh_name, materialise, written

#: Fixed patterns. name -> (pattern, group whose length counts, least length to report as such, role, least length to be a weak candidate).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
IDENTIFIER = r"""((?i:user(?:name)?|login|client_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+"""
BASE = {"assign": (ASSIGN, 2, 12), "access": (ACCESS, 0, 18), "hex": (HEX, 0, 16)}
#: An assignment whose value is shorter than a base one's, but has this length at least, is a weak secret.
WEAK_SECRET = 6
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_secret": "secret", "weak_id": "id", "endpoint": "endpoint"}
PATTERNS = [(ASSIGN, 2), (ACCESS, 0), (HEX, 0), (IDENTIFIER, 2), (ENDPOINT, 0)]
#: Parts whose starts are at most so many code points apart are in one scope.
SCOPE = 200


def _matches(text: Column, pattern: str, group: int, kind: int) -> Column:
    """The matches as structs of kind, length of the piece before, length of the match and of the group; empty without one."""
    size = lambda parts: F.transform(parts, lambda x: F.length(x))
    pieces, found = size(F.split(text, pattern, -1)), size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    value = size(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    zipped = F.transform(F.arrays_zip(pieces, found, value), lambda x: F.struct(F.lit(kind).alias("p"), x["0"].alias("gap"), x["1"].alias("len"), x["2"].alias("own")))
    some = F.rlike(text, F.lit(pattern))
    if kind == PATTERNS.index((ENDPOINT, 0)):
        some = F.contains(text, F.lit("://")) & some
    # the other branch must not hold `zipped`: what two branches share is worked out before the condition is looked at
    return F.when(some, F.filter(zipped, lambda x: x["len"].isNotNull())).otherwise(F.array().cast("array<struct<p:int,gap:int,len:int,own:int>>"))


def _found(text: Column) -> Column:
    """All matches of all patterns in a text; null is as empty."""
    body = F.coalesce(text, F.lit(""))
    return F.flatten(F.array(*(_matches(body, p, g, i) for i, (p, g) in enumerate(PATTERNS))))


def _parts(scanned: DataFrame, rid: str, found: str) -> DataFrame:
    """(rid, kind, start, end) of every base span and every part that may be linked."""
    rows = scanned.select(F.col(rid).alias("rid"), F.posexplode(found).alias("at", "m")).select("rid", "at", "m.*")
    before = W.partitionBy("rid", "p").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
    strong = (F.col("p") == 0) & (F.col("own") >= BASE["assign"][2])
    kind = F.when(strong, 0).when((F.col("p") == 0) & (F.col("own") >= WEAK_SECRET), 3).when(F.col("p").isin(1, 2), F.col("p")).when(F.col("p") == 3, 4).when(F.col("p") == 4, 5)
    return rows.select("rid", kind.alias("kind"), (F.col("end") - F.col("len")).alias("start"), "end").where("kind is not null")


def _linked(parts: DataFrame) -> DataFrame:
    """The weak parts that have what completes them within SCOPE: an interval join on bins of SCOPE code points.

    What a bin holds of each role is summed up first (the last start to its left, whether it has one, the first to its right), so a scope
    with many parts is joined with one row, not with each of them."""
    role = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k]))), F.col("kind"))
    placed = parts.withColumn("role", role).withColumn("bin", F.floor(F.col("start") / SCOPE).cast("long"))
    seen = placed.select("rid", "role", "start", F.explode(F.array(F.struct((F.col("bin") - 1).alias("bin"), F.lit(1).alias("side")), F.struct("bin", F.lit(0).alias("side")), F.struct((F.col("bin") + 1).alias("bin"), F.lit(-1).alias("side")))).alias("b"))
    held = []
    for r in ("id", "secret", "endpoint"):
        own = F.col("role") == r
        held += [F.count_if(own & (F.col("b.side") == 0)).alias(f"{r}_here"), F.max(F.when(own & (F.col("b.side") == -1), F.col("start"))).alias(f"{r}_left"), F.min(F.when(own & (F.col("b.side") == 1), F.col("start"))).alias(f"{r}_right")]
    scopes = seen.groupBy("rid", "b.bin").agg(*held)
    near = lambda r: (F.col(f"{r}_here") > 0) | F.coalesce(F.col(f"{r}_left") >= F.col("start") - SCOPE, F.lit(False)) | F.coalesce(F.col(f"{r}_right") <= F.col("start") + SCOPE, F.lit(False))
    complete = ((F.col("kind") == 3) & (near("id") | near("endpoint"))) | ((F.col("kind") == 4) & near("secret")) | ((F.col("kind") == 5) & near("id") & near("secret"))
    return placed.where("kind >= 3").join(scopes, ["rid", "bin"]).where(complete).select("rid", "kind", "start", "end")


def _spans(scanned: DataFrame, rid: str, found: str) -> DataFrame:
    parts = materialise(_parts(scanned, rid, found))
    return parts.where("kind < 3").union(_linked(parts))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`: its id and `spans`, an array of (start, kind, end) by start, then by the order of KINDS.

    A null text is empty and has no spans. Rows that repeat are scanned each on its own; null ids stay. Other columns are not read.
    """
    scanned = materialise(df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), _found(F.col(text_col)).alias("found")))
    ordered = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    spans = _spans(scanned, "row", "found").groupBy("rid").agg(ordered.alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    dirty = scanned.where(F.size("found") > 0).join(spans, F.col("row") == F.col("rid"), "left").select("id", F.coalesce("spans", none).alias("spans"))
    rows = scanned.where(F.size("found") == 0).select("id", none.alias("spans")).union(dirty)
    names = F.array(*(F.lit(k) for k in KINDS))
    named = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), F.get(names, x["kind"]).alias("kind"), x["end"].alias("end")))
    return rows.select(F.col("id").alias(id_col), named.alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """From `secret_spans` to counts of the base kinds, the hash of the base spans and all spans as one string."""
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    kept = [c for c in spans.columns if c != "spans"]
    return spans.select(*kept, *(count(k) for k in BASE), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """The rows of `df` with every span replaced by `mark`; spans that overlap are replaced as one. Columns are those of `df`; null texts stay null,
    rows that repeat stay as many. Only texts in which a pattern was found are joined with their spans."""
    rid, found = fresh_name(df, "scan_row"), fresh_name(df, "scan_found")
    scanned = written(df.withColumns({rid: F.monotonically_increasing_id(), found: _found(F.col(f"`{text_col}`"))}), "scanned")
    clean, dirty = scanned.where(F.size(found) == 0), scanned.where(F.size(found) > 0)
    spans = _spans(scanned, rid, found)
    ahead = W.partitionBy("rid").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    runs = spans.withColumn("new", F.coalesce((F.col("start") > F.max("end").over(ahead)).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(W.partitionBy("rid").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("rid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    of_row, spanned = fresh_name(dirty, "span_row"), fresh_name(dirty, "span_runs")
    runs = runs.withColumnsRenamed({"rid": of_row, "runs": spanned})
    text = F.col(f"d.`{text_col}`")
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), F.transform(spanned, lambda x: x["end"])), F.concat(F.transform(spanned, lambda x: x["start"]), F.array(F.length(text).cast("long"))))
    pieces = F.transform(gaps, lambda x: F.substring(text, (x["0"] + 1).cast("int"), (x["1"] - x["0"]).cast("int")))
    joined = dirty.alias("d").join(runs, F.col(f"d.`{rid}`") == F.col(of_row), "left")
    changed = F.when(F.col(spanned).isNull(), text).otherwise(F.array_join(pieces, mark))
    return clean.select(*(F.col(f"`{c}`") for c in df.columns)).union(joined.select(*(changed.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in df.columns)))
