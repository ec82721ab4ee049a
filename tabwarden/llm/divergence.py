"""How far the word use of the sources of a language is apart, exactly, in whole numbers.

Tasks take terms from the bytes of whole texts with numpy and count them sorted: a term of up to 8 bytes is
one 64-bit word and one of up to 16 two, radix-sorted by digits of 16 bits; longer terms lie in buckets by
the power of two that holds them and are sorted as bytes.  Runs of equal (group, term) are counted with
their documents and added up in the task before they are dealt out by (language, term), so that a common
word is a few rows a task whatever its count.

Every group's parts of a term need what it would be with no occurrence too, for each other source.  Those are
added up from how often each count occurs in a group, and only terms that two sources share are looked at
in pairs, within a task, as running sums.

Defined cases.  A null text, language or source is ''.  A text without terms still makes its group.
A language that keeps no term has all its pairs at 0 and no terms.  Equal rows count as often as they occur.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.llm import bytetext
from tabwarden.llm.tables import written

#: Bytes of text that are counted at once, but for a single longer text, and rows of counts that a task adds up.
COUNT_BYTES, HELD = 8 << 20, 1 << 19
#: Shares are whole numbers of this part.
UNIT = 1_000_000_000
COUNTS = "lang string, source string, term string, n long, docs long"

_TERM = np.ones(256, dtype=bool)
_TERM[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def radix_order(words: list[np.ndarray], n: int) -> np.ndarray:
    """The stable order of rows by 64-bit words, the least significant word first."""
    order = np.arange(n)
    for word in words:
        for shift in range(0, 64, 16):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if n and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]  # a radix sort for 16 bits
    return order


def _spans(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _TERM[low]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begins[first], ends[last] = inside[first], inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _runs(order: np.ndarray, columns: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of each run of equal columns, rows in it, documents in it); rows of a run are ordered by document."""
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    other = new.copy()
    other[1:] |= doc[order][1:] != doc[order][:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order))), np.add.reduceat(other.astype(np.int64), at)


def count_terms(raw: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of the texts that lie in `raw`; group: a number of each text."""
    low = _LOWER[raw]
    starts, ends = _spans(low, offsets) if len(low) else (np.zeros(0, dtype=np.int64),) * 2
    doc = np.searchsorted(offsets, starts, side="right") - 1
    size = ends - starts
    padded = np.append(low, np.zeros(16, dtype=np.uint8))
    at_byte = np.ndarray(len(padded) - 7, dtype=">u8", buffer=padded, strides=(1,))  # eight bytes from every place
    out: list[tuple] = []

    def word(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        cut = np.uint64(8) * (np.uint64(8) - np.clip(length, 1, 8).astype(np.uint64))
        return (at_byte[begin].astype(np.uint64) >> cut) << cut

    def add(rows: np.ndarray, order: np.ndarray, columns: list[np.ndarray], terms) -> None:
        if len(rows):
            one, n, docs = _runs(order, [*columns, group[doc[rows]]], doc[rows])
            out.append((group[doc[rows]][one], terms(one), n, docs))

    rows = np.flatnonzero(size <= 8)
    key, own = word(starts[rows], size[rows]), group[doc[rows]].astype(np.uint64)
    add(rows, radix_order([key, own], len(rows)), [key], lambda one: key[one].astype(">u8").view("S8").tolist())
    rows = np.flatnonzero((size > 8) & (size <= 16))
    high, rest, own = word(starts[rows], size[rows]), word(starts[rows] + 8, size[rows] - 8), group[doc[rows]].astype(np.uint64)
    add(rows, radix_order([rest, high, own], len(rows)), [rest, high], lambda one: np.stack([high[one], rest[one]], axis=1).astype(">u8").view("S16").ravel().tolist())
    long = np.flatnonzero(size > 16)
    bucket = np.ceil(np.log2(size[long])).astype(np.int64)
    for b in np.unique(bucket).tolist():
        rows = long[bucket == b]
        width = int(size[rows].max())
        text = np.zeros((len(rows), width), dtype=np.uint8)
        for i, (s, e) in enumerate(zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)):
            text[i, : e - s] = low[s:e]
        text = text.view(f"S{width}").ravel()
        by_term = np.argsort(text, kind="stable")
        order = by_term[radix_order([group[doc[rows]].astype(np.uint64)[by_term]], len(rows))]
        add(rows, order, [text], lambda one, text=text: text[one].tolist())
    if not out:
        return np.zeros(0, dtype=np.int64), [], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([o[0] for o in out]), [t for o in out for t in o[1]], np.concatenate([o[2] for o in out]), np.concatenate([o[3] for o in out])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): partial counts of tasks, and a row with the term '' and the documents of each group."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    names = ["lang", "source", "term", "n", "docs"]

    def summed(parts: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(parts).group_by(names[:3]).aggregate([("n", "sum"), ("docs", "sum")])
        return whole.select([*names[:3], "n_sum", "docs_sum"]).rename_columns(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for lo, hi, raw, offsets in bytetext.chunks(batch.column("text"), COUNT_BYTES):
                lang, source = batch.column("lang").slice(lo, hi - lo), batch.column("source").slice(lo, hi - lo)
                pairs = pa.StructArray.from_arrays([lang.cast(pa.string()), source.cast(pa.string())], ["lang", "source"]).to_pylist()
                known: dict = {}
                group = np.array([known.setdefault((p["lang"], p["source"]), len(known)) for p in pairs], dtype=np.int64)
                own, terms, n, in_docs = count_terms(raw, offsets, group)
                own = np.append(own, np.arange(len(known)))
                langs, sources = pa.array([k[0] for k in known]), pa.array([k[1] for k in known])
                of = pa.array(own)
                term = pa.array([*terms, *[b""] * len(known)], pa.binary()).cast(pa.string())
                part = pa.table([langs.take(of), sources.take(of), term, pa.array(np.append(n, np.zeros(len(known), dtype=np.int64))), pa.array(np.append(in_docs, np.bincount(group, minlength=len(known))))], names=names)
                parts.append(part)
                held += part.num_rows
                if held > HELD:
                    whole = summed(parts)
                    if whole.num_rows > HELD // 2:
                        yield from whole.to_batches(1 << 16)
                        parts, held = [], 0
                    else:
                        parts, held = [whole], whole.num_rows
        if parts:
            yield from summed(parts).to_batches(1 << 16)

    return named.mapInArrow(run, COUNTS)


def _share(count: str, of: str) -> str:
    """1 + floor(UNIT * (count + 1) / of) in three steps of a thousand, so that no product leaves 64 bits."""
    rest, found = f"({count} + 1L)", "0L"
    for _ in range(3):
        found, rest = f"({found} * 1000L + ({rest} * 1000L) div ({of}))", f"(({rest} * 1000L) % ({of}))"
    return f"(1L + {found})"


def _apart(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def kept_terms(counts: DataFrame, least_docs: int = 3) -> DataFrame:
    """(lang, source, term, n, n_lang, first): terms in `least_docs` documents of their language, and the rows of groups (term '')."""
    whole = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    about = whole.select("*", F.sum("docs").over(same).alias("lang_docs"), F.sum("n").over(same).alias("n_lang"), F.min("source").over(same).alias("least"))
    return about.where((F.col("lang_docs") >= least_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "n_lang", (F.col("least") == F.col("source")).alias("first"))


def group_sizes(kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, kinds): kept occurrences of a group and of its language, and the language's kept terms."""
    per = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("first") & (F.col("term") != "")).alias("firsts"))
    lang = Window.partitionBy("lang")  # a row a source
    return per.select("lang", "source", "total", F.sum("total").over(lang).alias("lang_total"), F.sum("firsts").over(lang).alias("kinds"))


def _shared_terms(shares: DataFrame) -> DataFrame:
    """(lang, source, item, value): over the terms that two sources share, what their pair differs from either being without it.

    shares (lang, term, source, p, p0): p0 is the source's share of a term that it doesn't have.
    """
    ordered = shares.repartition("lang", "term").sortWithinPartitions("lang", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = {}

        def take(rows: pa.Table) -> None:
            lang, term, source = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
            l, t, s = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lang, term, source))
            p, p0 = rows["p"].to_numpy(), rows["p0"].to_numpy()
            kinds = len(source.dictionary)
            for d in range(1, len(p)):  # as many steps as a term has sources
                at = np.flatnonzero((l[d:] == l[:-d]) & (t[d:] == t[:-d]))
                if not len(at):
                    break
                for a, b in ((at, at + d), (at + d, at)):
                    far = lambda x, y: (x - y) * (x - y) // y
                    value = far(p[a], p[b]) - far(p[a], p0[b]) - far(p0[a], p[b]) + far(p0[a], p0[b])
                    key = (l[a] * kinds + s[a]) * kinds + s[b]
                    order = np.argsort(key, kind="stable")
                    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
                    for k, v in zip(key[order][first].tolist(), np.add.reduceat(value[order], first).tolist(), strict=True):
                        name = (lang.dictionary[k // kinds // kinds].as_py(), source.dictionary[k // kinds % kinds].as_py(), source.dictionary[k % kinds].as_py())
                        sums[name] = sums.get(name, 0) + v

        def out() -> pa.RecordBatch:
            names = list(zip(*sums, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in names), pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "item", "value"])

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not rows.num_rows:
                continue
            last = rows.slice(rows.num_rows - 1)
            l, t = rows["lang"], rows["term"]
            same = pc.and_(pc.equal(l, last["lang"][0]), pc.equal(t, last["term"][0])).to_numpy()
            whole = int(np.argmax(same))  # the last term may go on in the next batch
            if whole:
                take(rows.slice(0, whole))
            rest = rows.slice(whole)
            if len(sums) > HELD:
                yield out()
                sums.clear()
        if rest is not None and rest.num_rows:
            take(rest)
        if sums:
            yield out()

    return ordered.mapInArrow(run, "lang string, source string, item string, value long")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other of its language (part 'pair'), and the terms that set it off from the language (part 'term', up to `most_terms` ranks)."""
    kept = written(kept_terms(term_counts(docs, text_col, lang_col, source_col), least_docs), "kept-terms")
    groups = written(group_sizes(kept), "term-groups")
    terms = kept.where("term <> ''").join(groups, ["lang", "source"])
    ranked = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))

    own = terms.select("lang", "source", F.col("term").alias("item"), F.expr(_share("n", "total + kinds")).alias("p"), F.expr(_share("n_lang", "lang_total + kinds")).alias("q"))
    term_part = ranked(own.where("p > q").withColumn("value", F.expr(_apart("p", "q"))), "term").where(F.col("rank") <= most_terms)

    zero = groups.select("lang", "source", F.col("total").alias("n_all"), "kinds", F.expr(f"CASE WHEN kinds > 0 THEN {_share('0L', 'total + kinds')} END").alias("p0"))
    a = zero.select("lang", "source", "kinds", F.col("p0").alias("a0"))
    b = zero.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"))
    pairs = a.join(b, "lang").where("source <> item")  # what the result has a row for
    base = pairs.select("lang", "source", "item", F.expr(f"coalesce(kinds * {_apart('a0', 'b0')}, 0L)").alias("value"))
    times = terms.groupBy("lang", "source", "n").agg(F.count("*").alias("times"), F.first("total").alias("total"), F.first("kinds").alias("kinds"))
    times = times.select("lang", "source", "times", F.expr(_share("n", "total + kinds")).alias("p"))
    left = pairs.join(times, ["lang", "source"]).select("lang", "source", "item", F.expr(f"times * ({_apart('p', 'b0')} - {_apart('a0', 'b0')})").alias("value"))
    right = pairs.join(times.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", F.expr(f"times * ({_apart('a0', 'p')} - {_apart('a0', 'b0')})").alias("value"))
    shares = terms.select("lang", "term", "source", F.expr(_share("n", "total + kinds")).alias("p"), F.expr(_share("0L", "total + kinds")).alias("p0"))
    both = _shared_terms(shares)
    whole = base.unionByName(left).unionByName(right).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return ranked(whole, "pair").unionByName(term_part)
