"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong findings (base kinds) are reported wherever they stand.  Weak parts - identifiers, unlabelled
secrets and endpoints - are reported only when their complement is near: identifiers and secrets are
linked by an interval join within `scope` code points of a text, and an endpoint is added where it lies
in the scope of such a link.

Positions come from marking the matches of a pattern, splitting at the marks and adding up the lengths.
The marks are U+0001, which no pattern matches and which is blanked in the text before.

Defined cases.  A null text is empty; texts without findings have counts of 0, the digest of the empty
string and no spans.  Each row is scanned; what equal texts have is linked once and given to each of their
rows, null ids included.  A host name is a whole run of its characters, so it ends at the last label.
Time grows in proportion to a text's length.  Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.llm.tables import written

_MARK, _BLANK = "\x01", "\x02"
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: kind: (pattern, what a match must satisfy, role in a link)
BASE_KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": (_ASSIGN, lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 6, "secret"),
    "access": (r"AKIA[A-Z0-9]+", lambda m: F.length(m) >= 20, "identifier"),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", lambda m: F.length(m) >= 24, "secret"),
    "identifier": (r"(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}|(?i:client|account|user|access_?key)_?(?i:id|name)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}", lambda m: F.length(m) >= 8, "identifier"),
    "blob": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}", lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]"), "secret"),
    "endpoint": (r"https?://[^\x00-\x20\"'<>]+|(?<![a-z0-9.-])[a-z0-9-]++(?:\.[a-z0-9-]++)*+(?<=\.(?:com|net|org|io|internal))(?::[0-9]+)?", lambda m: F.length(m) >= 6, "endpoint"),
}
WEAK_KINDS = ("identifier", "blob", "endpoint")


def _pieces(text: Column, pattern: str) -> Column:
    """Lengths of the stretches between and in the matches, in turn, with the matches themselves."""
    marked = F.regexp_replace(F.translate(text, _MARK, _BLANK), pattern, f"{_MARK}$0{_MARK}")
    return F.transform(F.split(marked, _MARK, -1), lambda x, i: F.struct(F.length(x).alias("n"), F.when(i % 2 == 1, x).alias("m")))


def spans(texts: DataFrame) -> DataFrame:
    """(text_key, text) -> (text_key, kind, start, end) of all strong findings and weak parts of each text."""
    scans = F.array(*(F.struct(F.lit(k).alias("kind"), _pieces(F.col("text"), p).alias("pieces")) for k, (p, _, _) in PATTERNS.items()))
    found = texts.select("text_key", F.explode(F.filter(scans, lambda s: F.size(s["pieces"]) > 1)).alias("s")).select("text_key", "s.kind", "s.pieces")
    found = found.dropDuplicates(["text_key", "kind"])
    pieces = found.select("text_key", "kind", F.posexplode("pieces").alias("at", "p")).select("text_key", "kind", "at", F.col("p.n").cast("long").alias("n"), F.col("p.m").alias("m"))
    through = F.sum("n").over(Window.partitionBy("text_key", "kind").orderBy("at"))
    placed = pieces.withColumn("end", through).where("m IS NOT NULL")
    keep = F.lit(False)
    for k, (_, holds, _) in PATTERNS.items():
        keep = F.when(F.col("kind") == k, holds(F.col("m"))).otherwise(keep)
    return placed.where(keep).select("text_key", "kind", (F.col("end") - F.col("n")).alias("start"), "end")


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """left (text_key, l_start, ...) joined with right (text_key, r_start, ...) where the starts are at most `scope` apart."""
    a = left.withColumn("cell", F.expr(f"l_start div {scope}"))
    b = right.withColumn("cell", F.explode(F.expr(f"sequence(r_start div {scope} - 1, r_start div {scope} + 1)")))
    return a.join(b, ["text_key", "cell"]).where(F.abs(F.col("l_start") - F.col("r_start")) <= scope).drop("cell")


def link(found: DataFrame, scope: int = 400) -> DataFrame:
    """(text_key, identifier kind, start, end, secret kind, start, end): identifiers and secrets of one scope."""
    role = {k: r for k, (_, _, r) in PATTERNS.items()}
    of = lambda r: F.col("kind").isin([k for k in role if role[k] == r])
    identifiers = found.where(of("identifier")).select("text_key", *(F.col(c).alias(f"l_{c}") for c in ("kind", "start", "end")))
    secrets = found.where(of("secret")).select("text_key", *(F.col(c).alias(f"r_{c}") for c in ("kind", "start", "end")))
    pairs = _near(identifiers, secrets, scope)
    return pairs.where((F.col("l_end") <= F.col("r_start")) | (F.col("r_end") <= F.col("l_start")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """(id_col, spans array of (start, kind_no, end, kind)) for every row: strong findings, and weak parts that are linked."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.col(id_col).alias("_id"), text.alias("text"), F.md5(text.cast("binary")).alias("text_key"))
    found = written(spans(named.select("text_key", "text")), "spans")
    strong = found.where(F.col("kind").isin(*BASE_KINDS))
    # a weak part that overlaps a strong finding is that finding
    weak = found.where(F.col("kind").isin(*WEAK_KINDS))
    cells = lambda s, e: F.explode(F.expr(f"sequence({s} div 64, ({e} - 1) div 64)"))
    taken = strong.select("text_key", F.col("start").alias("s_start"), F.col("end").alias("s_end"), cells("start", "end").alias("cell"))
    in_cells = weak.withColumn("cell", cells("start", "end"))
    overlaps = in_cells.join(taken, (in_cells["text_key"] == taken["text_key"]) & (in_cells["cell"] == taken["cell"]) & (F.col("start") < F.col("s_end")) & (F.col("s_start") < F.col("end")), "left_semi")
    free = weak.join(overlaps.select("text_key", "kind", "start").distinct(), ["text_key", "kind", "start"], "left_anti")
    candidates = written(strong.unionByName(free), "parts")
    pairs = written(link(candidates, scope), "links")
    ends = candidates.where(F.col("kind") == "endpoint").select("text_key", F.col("kind").alias("l_kind"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    centres = pairs.select("text_key", F.col("l_start").alias("r_start")).distinct()
    linked = pairs.select("text_key", F.col("l_kind").alias("kind"), F.col("l_start").alias("start"), F.col("l_end").alias("end"))
    linked = linked.unionByName(pairs.select("text_key", F.col("r_kind").alias("kind"), F.col("r_start").alias("start"), F.col("r_end").alias("end")))
    linked = linked.unionByName(_near(ends, centres, scope).select("text_key", F.col("l_kind").alias("kind"), F.col("l_start").alias("start"), F.col("l_end").alias("end")))
    reported = strong.unionByName(linked.where(F.col("kind").isin(*WEAK_KINDS)).distinct())
    number = F.lit(0)
    for i, k in enumerate(PATTERNS):
        number = F.when(F.col("kind") == k, F.lit(i)).otherwise(number)
    by_text = reported.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", number.alias("kind_no"), "end", "kind"))).alias("spans"))
    empty = F.array().cast("array<struct<start:long,kind_no:int,end:long,kind:string>>")
    return named.select("_id", "text_key").join(by_text, "text_key", "left").select(F.col("_id").alias(id_col), F.coalesce("spans", empty).alias("spans"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, and the spans as text and digest."""
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_KINDS))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(id_col, *(n(k) for k in BASE_KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
