"""Personal data in texts: detection, overlap resolution, sensitivity policy and protection.

Detectors are column expressions text -> array<span>; a text is read once for all of them.  Positions are
code points: matches are marked, the text is split at the marks and the lengths are added up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MARK, _BLANK = "\x01", "\x02"
SPAN = "struct<entity:string,value:string,start:int,end:int,confidence:double>"

# Valid dialling codes, entity priorities, label aliases and their sensitivity scores.
MOBILE_CODES = ("070", "071", "072", "074", "075", "076", "077", "078")
LANDLINE_CODES = ("011", "021", "023", "024", "025", "026", "027", "031", "032", "033", "034", "035", "036", "037", "038", "041", "045", "047", "051", "052", "054", "055", "057", "063", "065", "066", "067", "081", "091")
BANK_LENGTHS = (11, 12, 13, 14, 15, 16, 18)
BANK_PREFIXES = "^(01|10|18|88|2042|1|2)"
PRIORITY = {"NIC": 100, "CREDIT_CARD": 100, "BANK_ACCOUNT": 90, "PHONE_NUMBER": 80, "IP_ADDRESS": 70, "MAC_ADDRESS": 70, "DATE": 60, "EMAIL": 60, "PER": 30, "ORG": 30, "LOC": 30, "MISC": 20}
LABELS = {"PERSON": "PER", "LOCATION": "LOC", "ORGANIZATION": "ORG", "IP_ADDRESS_V4": "IP_ADDRESS", "IP_ADDRESS_V6": "IP_ADDRESS"}
SENSITIVITY = {"Low": 1, "Medium": 3, "High": 5, "Critical": 5}


@dataclass(frozen=True)
class Detector:
    entity: str
    pattern: str
    valid: Callable[[Column], Column]
    confidence: Callable[[Column], Column]


def _folded(items: Column, shape: str, state: Column, step: Callable[[Column, Column], Column], item: str) -> Column:
    """struct<state, out>: a fold that appends to a list, in blocks of about the square root of the list's length, so that neither blocks nor their list are long to copy.

    step(acc, x) works on acc `struct<state:SHAPE,out:array<ITEM>>`.
    """
    acc_type, none = f"struct<state:{shape},out:array<{item}>>", F.array().cast(f"array<{item}>")
    block = (F.ceil(F.sqrt(F.size(items)) / 2) * 2).cast("int")
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, block)).otherwise(F.array().cast("array<int>"))
    outer_type = f"struct<i:{acc_type},out:array<array<{item}>>>"
    first = F.struct(F.struct(state.alias("state"), none.alias("out")).alias("i"), F.array().alias("out")).cast(outer_type)

    # no casts, slices or transforms in here: each copies lists; a block's list is taken over when the next block is done
    def blocks(acc: Column, at: Column) -> Column:
        places = F.sequence(at, F.least(at + block, F.size(items)) - 1)
        inner = F.aggregate(places, F.struct(acc["i"]["state"].alias("state"), none.alias("out")), lambda a, i: step(a, F.get(items, i)))
        return F.struct(inner.alias("i"), F.array_append(acc["out"], acc["i"]["out"]).alias("out"))

    folded = F.aggregate(starts, first, blocks)
    return F.transform(F.array(folded), lambda f: F.struct(f["i"]["state"].alias("state"), F.flatten(F.array_append(f["out"], f["i"]["out"])).alias("out")))[0]


def matches(text: Column, pattern: str) -> Column:
    """array<struct<value, start, end>> of a pattern's matches."""
    pieces = F.split(F.regexp_replace(F.translate(text, _MARK, _BLANK), pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    span, shape = "struct<value:string,start:int,end:int>", "struct<at:int,odd:boolean>"

    def step(acc: Column, x: Column) -> Column:
        at, odd = acc["state"]["at"], acc["state"]["odd"]
        end = at + F.length(x)
        found = F.struct(x.alias("value"), at.alias("start"), end.alias("end"))
        return F.struct(F.struct(end.alias("at"), (~odd).alias("odd")).alias("state"), F.when(odd, F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    # the pattern is run once: a text without matches is one piece
    run = lambda p: F.when(F.size(p) > 1, _folded(p, shape, F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd")), step, span)["out"]).otherwise(F.array().cast(f"array<{span}>"))
    return F.transform(F.array(pieces), run)[0]


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _card(c: Column) -> Column:
    d = digits(c)
    known = d.rlike("^4(\\d{12}|\\d{15}|\\d{18})$") | d.rlike("^5[1-5]\\d{14}$") | d.rlike("^3[47]\\d{13}$") | d.rlike("^6(011|5)\\d+$")
    return known & F.call_function("luhn_check", d)


def _phone(c: Column) -> Column:
    d = digits(c)
    local = F.when(d.startswith("94"), F.concat(F.lit("0"), F.substring(d, 3, 20))).otherwise(d)
    return (F.length(local) == 10) & (F.substring(local, 1, 3).isin(*MOBILE_CODES) | F.substring(local, 1, 3).isin(*LANDLINE_CODES))


def _day(c: Column) -> Column:
    d = c.try_cast("int")
    return d.between(1, 366) | d.between(501, 866)


def _old_nic(c: Column, year: Column | None = None) -> Column:
    return _day(F.substring(c, 3, 3)) & ((F.substring(c, 1, 2).try_cast("int") + 1900) <= (F.year(F.current_date()) if year is None else year))


def _new_nic(c: Column, year: Column | None = None) -> Column:
    return F.substring(c, 1, 4).try_cast("int").between(F.lit(1900), F.year(F.current_date()) if year is None else year) & _day(F.substring(c, 5, 3))


def _ipv4(c: Column) -> Column:
    return F.forall(F.split(c, r"\."), lambda x: (x.try_cast("int") <= 255) & ~x.rlike("^0\\d"))


def to_iso(c: Column) -> Column:
    """A date candidate as yyyy-MM-dd, by sixteen formats; two-digit years from 69 on are of the last century.

    Days first (/ - . or blanks, two-digit years without the dot), years first (/ - or blanks), and months by
    name before or after the day; separators of one date are the same.
    """
    plain = F.regexp_replace(F.trim(c), r"\s+", " ")
    same = F.translate(F.replace(plain, F.lit(",")), "/. ", "---")
    parsed = lambda *formats: F.coalesce(*(F.try_to_timestamp(same, F.lit(f)).cast("date") for f in formats))
    short = parsed("d-M-yy")
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    date = (
        F.when(plain.rlike(r"^\d{1,2}([/. -])\d{1,2}\1\d{4}$"), parsed("d-M-yyyy"))
        .when(plain.rlike(r"^\d{1,2}([/ -])\d{1,2}\1\d{2}$"), short)
        .when(plain.rlike(r"^\d{4}([/ -])\d{1,2}\1\d{1,2}$"), parsed("yyyy-M-d"))
        .when(plain.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), parsed("d-MMM-yyyy", "d-MMMM-yyyy"))
        .when(plain.rlike(r"^[A-Za-z]+ \d{1,2},? \d{4}$"), parsed("MMM-d-yyyy", "MMMM-d-yyyy"))
    )
    return F.date_format(date, "yyyy-MM-dd")


_always = lambda c: F.lit(True)
_sure = lambda x: lambda c: F.lit(x)

def _ipv6(c: Column) -> Column:
    """Eight groups of up to four hex digits, or fewer with one `::`; a `:` at an end only as part of it."""
    groups = F.size(F.filter(F.split(c, ":"), lambda x: x != ""))
    doubles = F.size(F.split(c, "::", -1)) - 1
    ends = ~c.rlike("^:[^:]|[^:]:$") & ~c.contains(":::")
    return ends & (((doubles == 0) & (groups == 8)) | ((doubles == 1) & (groups <= 7))) & ~c.rlike("[0-9A-Fa-f]{5}")


IPV6 = (Detector("IP_ADDRESS", r"(?<![0-9A-Fa-f:.])(?=[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{2,45}(?![0-9A-Fa-f:.])", lambda c: c.contains(":") & _ipv6(c), _sure(0.95)),)

DETECTORS = (
    Detector("NIC", r"\b\d{9}[VXvx]\b", _old_nic, _sure(0.95)),
    Detector("NIC", r"\b\d{12}\b", _new_nic, _sure(0.95)),
    Detector("CREDIT_CARD", r"\b\d{13,19}\b", _card, _sure(0.95)),
    Detector("BANK_ACCOUNT", r"\b\d{10,18}\b", lambda c: F.length(c).isin(*BANK_LENGTHS), lambda c: F.when(c.rlike(BANK_PREFIXES), 0.6).otherwise(0.4)),
    Detector("PHONE_NUMBER", r"(?:\+94|0)[\s\-]*\d{2}(?:[\s\-]*\d{3,4}){2}", _phone, _sure(0.9)),
    Detector("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", _ipv4, _sure(0.95)),
    Detector("MAC_ADDRESS", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", _always, _sure(0.95)),
    Detector("MAC_ADDRESS", r"\b(?:[0-9A-Fa-f]{4}\.){2}[0-9A-Fa-f]{4}\b", _always, _sure(0.95)),
    Detector("DATE", r"\b\d{1,4}[\s/.-]\d{1,2}[\s/.-]\d{1,4}\b|\b\d{1,2}\s+(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4}\b|\b(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b", lambda c: to_iso(c).isNotNull(), _sure(0.9)),
    Detector("EMAIL", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", _always, _sure(0.95)),
    *IPV6,
)


def confident(labels: DataFrame, least: float = 0.6) -> DataFrame:
    """Labels under their canonical names, without `O` and those of low confidence."""
    return labels.withColumn("entity", canonical_label(F.col("entity"))).where((F.col("entity") != "O") & (F.col("confidence") >= least))


def mac_class(c: Column) -> Column:
    """UAA or LAA by the second bit of the first byte."""
    first = F.conv(F.substring(F.regexp_replace(c, "[^0-9A-Fa-f]", ""), 1, 2), 16, 10).cast("int")
    return F.when(first.bitwiseAND(2) == 0, "UAA").otherwise("LAA")


def detect(text: Column, detectors: tuple[Detector, ...] = DETECTORS) -> Column:
    """array<SPAN> of all valid matches, by start, then in the detectors' order."""
    found = []
    for d in detectors:
        found.append(F.transform(F.filter(matches(text, d.pattern), _valid(d)), _as_span(d)))
    return F.concat(*found)


def _valid(d: Detector):
    return lambda m: F.coalesce(d.valid(m["value"]), F.lit(False))


def _as_span(d: Detector):
    return lambda m: F.struct(F.lit(d.entity).alias("entity"), m["value"].alias("value"), m["start"].alias("start"), m["end"].alias("end"), d.confidence(m["value"]).cast("double").alias("confidence")).cast(SPAN)


def _rank(entity: Column) -> Column:
    out = F.lit(10)
    for k, v in PRIORITY.items():
        out = F.when(entity == k, F.lit(v)).otherwise(out)
    return out


def resolve(spans: Column) -> Column:
    """Overlaps settled in the order of starts: a newcomer stays only if it beats what it overlaps.

    Spans that stay are apart from each other, so a newcomer, whose start isn't before theirs, can only overlap
    the last of them: one span is held open.
    """
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-_rank(s["entity"])).alias("rank"), (-s["confidence"]).alias("sure"), s.alias("s")))
    ordered = F.transform(F.sort_array(keyed), lambda k: k["s"])

    def step(acc: Column, s: Column) -> Column:
        o = acc["state"]["last"]
        apart = o.isNull() | (s["start"] >= o["end"])
        stronger = (_rank(s["entity"]) > _rank(o["entity"])) | ((_rank(s["entity"]) == _rank(o["entity"])) & (s["confidence"] > o["confidence"]))
        last = F.when(apart | stronger, s).otherwise(o)
        out = F.when(apart & o.isNotNull(), F.array_append(acc["out"], o)).otherwise(acc["out"])
        return F.struct(F.struct(last.alias("last")).alias("state"), out.alias("out"))

    def settled(items: Column) -> Column:
        folded = _folded(items, f"struct<last:{SPAN}>", F.struct(F.lit(None).cast(SPAN).alias("last")), step, SPAN)
        return F.transform(F.array(folded), lambda f: F.when(f["state"]["last"].isNull(), f["out"]).otherwise(F.array_append(f["out"], f["state"]["last"])))[0]

    return F.transform(F.array(ordered), settled)[0]


def normal_value(entity: Column, value: Column) -> Column:
    return F.when(entity.isin("PHONE_NUMBER", "CREDIT_CARD", "BANK_ACCOUNT"), digits(value)).otherwise(F.lower(F.trim(value)))


def entities(docs: DataFrame, id_col: str, text_col: str, detectors: tuple[Detector, ...] = DETECTORS, resolved: bool = True) -> DataFrame:
    """(id_col, entity, value, start, end, confidence): one row a span; of equal values in a text the surest, then first."""
    spans = detect(F.coalesce(F.col(text_col), F.lit("")), detectors)
    rows = docs.select(id_col, F.explode(resolve(spans) if resolved else spans).alias("s")).select(id_col, "s.*")
    order = Window.partitionBy(id_col, "entity", normal_value(F.col("entity"), F.col("value"))).orderBy(F.desc("confidence"), "start")
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k") if resolved else rows


def bio_spans(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, pos, token, label) -> (doc, entity, value, start_pos, end_pos, confidence): runs of B- and I- labels."""
    order = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.regexp_replace("label", "^[BI]-", "")
    before = F.lag("label").over(Window.partitionBy(doc).orderBy("pos"))
    opens = F.col("label").startswith("B-") | (F.col("label").startswith("I-") & (F.coalesce(F.regexp_replace(before, "^[BI]-", ""), F.lit("O")) != kind))
    runs = tokens.withColumn("kind", kind).withColumn("run", F.sum(opens.cast("int")).over(order)).where("label <> 'O'")
    return runs.groupBy(doc, "run", "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("value"), F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos")).select(doc, F.col("kind").alias("entity"), "value", "start_pos", "end_pos", F.lit(0.85).alias("confidence"))


def canonical_label(c: Column) -> Column:
    out = F.upper(c)
    for k, v in LABELS.items():
        out = F.when(F.upper(c) == k, F.lit(v)).otherwise(out)
    return out


def with_sensitivity(found: DataFrame, policies: DataFrame) -> DataFrame:
    """policies (entity, sensitivity_level): the highest level of an entity, `Unknown` where there is none."""
    rank = F.array_position(F.array(*(F.lit(x) for x in ("Low", "Medium", "High", "Critical"))), F.col("sensitivity_level"))
    levels = policies.groupBy(F.upper("entity").alias("_e")).agg(F.max_by("sensitivity_level", rank).alias("sensitivity_level"))
    joined = found.join(F.broadcast(levels), canonical_label(F.col("entity")) == F.col("_e"), "left").drop("_e")  # a policy table
    return joined.withColumn("sensitivity_level", F.coalesce("sensitivity_level", F.lit("Unknown")))


def risk_score(level: Column, compliance: Column) -> Column:
    out = F.lit(1)
    for k, v in SENSITIVITY.items():
        out = F.when(level == k, F.lit(v)).otherwise(out)
    return F.round(0.7 * out + 0.3 * compliance, 4)


def method(entity: Column, score: Column) -> Column:
    return F.when(entity == "PASSWORD", "hash_password").when(score <= 2, "mask").when(score <= 3.5, "hash").when(score <= 4.5, "encrypt").otherwise("tokenize")


def mask(c: Column) -> Column:
    n = F.length(c)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(c, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(c, F.lit(2))))


def salted_hash(c: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), c), 256)


def encrypt(c: Column, key: str) -> Column:
    """Base64 of nonce, AES-GCM text and tag; the key comes from configuration."""
    return F.base64(F.aes_encrypt(c.cast("binary"), F.lit(key).cast("binary"), F.lit("GCM")))


def decrypt(c: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(c), F.lit(key).cast("binary"), F.lit("GCM")).cast("string")


def tokenize(values: DataFrame, column: str, key: str) -> DataFrame:
    """Vault (value, token) of the distinct values: keyed and the same in every run."""
    return values.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct().withColumn("token", F.concat(F.lit("TKN_"), F.left(F.sha2(F.concat(F.lit(key), "value"), 256), F.lit(32))))


def generalize_place(c: Column) -> Column:
    return F.trim(F.element_at(F.split(c, ","), -1))


def redact(text: Column, replacements: Column) -> Column:
    """replacements array<struct<value, safe>>: longest values first, every occurrence."""
    ordered = F.sort_array(F.transform(replacements, lambda r: F.struct((-F.length(r["value"])).alias("n"), r["value"].alias("value"), r["safe"].alias("safe"))))
    return F.aggregate(ordered, text, lambda acc, r: F.replace(acc, r["value"], r["safe"]))
