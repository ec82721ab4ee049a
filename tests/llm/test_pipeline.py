"""Whole texts and whole corpora: what earlier forms cut, and the stages of the pipeline, against plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabwarden.llm import license_scan, mixing, ppm, quality
from tabwarden.llm.tables import held_out

SF = "/root/testdata/sf0.001"


def test_scores_whatever_the_hot_trie_holds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + 2, "né 漢字 Ω"), (10**6 + 3, None), (10**6 + 4, "漢字 Ωmega")], "doc_id long, text string"))
    scores = lambda most: {r["doc_id"]: r["score"] for r in ppm.score(docs, ~held_out("doc_id", 7), max_nodes=most).collect()}
    whole = scores(1 << 32)
    for most in (0, 3000):
        assert scores(most) == pytest.approx(whole, rel=1e-9)


def test_every_license_of_a_text(spark, tmp_path):
    templates = license_scan.TEMPLATES
    texts = [" so it is said ".join(t for _, t, _ in templates), f"{templates[3][1]} . . . {templates[11][1]}", f"{templates[3][1]} and then {templates[15][1]}", "cc by nc alone"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(d).collect()}
    for i, t in enumerate(texts):
        words = re.findall("[a-z0-9]+", t)
        expected = set()
        for label, template, need in templates:
            x = template.split()
            for start in range(-len(x), len(words)):
                share = sum(0 <= start + q < len(words) and words[start + q] == w for q, w in enumerate(x)) / len(x)
                near = words[max(0, start - 4) : max(0, start + len(x) + 4)]
                if share >= 0.6 and all(f" {p} " in f" {' '.join(near)} " for p in need):
                    expected.add((label, start))
        assert {(m["label"], m["start_word"]) for m in got[i]["matches"]} == expected
    assert {x[0] for x in templates} <= set(got[0]["labels"].split(","))
    assert {"mit", "cc-by-nc"} <= set(got[1]["labels"].split(",")) and {"mit", "unlicense"} <= set(got[2]["labels"].split(","))


@pytest.fixture(scope="module")
def null_and_repeated(spark, tmp_path_factory):
    """(folder, documents, items): rows of null and repeated ids, some of which leak items."""
    tmp_path = tmp_path_factory.mktemp("corpus")
    base = spark.read.parquet(f"{SF}/documents.parquet")
    few = base.where("doc_id < 120").withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, F.col("doc_id") % 20).otherwise(F.col("doc_id")))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(5)
    leaks = items.select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("so it was said: "), "text").alias("text"))
    few = few.unionByName(leaks, allowMissingColumns=True).unionByName(few.where("doc_id IS NULL").limit(3))
    few.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    items.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), docs, items


def shown(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_pipeline_quality(spark, null_and_repeated):
    folder, docs, items = null_and_repeated
    rows = corpus_pipeline._numbered(docs, "test").toPandas()
    assert sorted(rows["_row"]) == list(range(len(rows)))
    # the verdict on a text is that of the model, whatever its id
    said = {r["_row"]: r["kept"] for r in quality.classify(corpus_pipeline._numbered(docs, "test"), id_col="_row").collect()}
    expected = Counter((None if i != i else int(i), t) for i, t, n in zip(rows["doc_id"], rows["text"], rows["_row"], strict=True) if said[n])
    assert shown(corpus_pipeline.quality_stage(spark, docs, folder)) == expected


def test_pipeline_decontamination(spark, null_and_repeated):
    folder, docs, items = null_and_repeated
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda t: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := plain(t)) else set()
    known = [grams(r["text"]) for r in items.collect()]
    leaky = lambda t: (own := grams(t)) and any(len(own & g) >= 0.8 * len(g) for g in known)
    expected = Counter({r: n for r, n in shown(docs).items() if not leaky(r[1])})
    assert shown(corpus_pipeline.decontamination_stage(spark, docs, folder)) == expected and sum(expected.values()) < docs.count()


def test_pipeline_near_dedup(spark, null_and_repeated):
    folder, docs, items = null_and_repeated
    deduped = corpus_pipeline.written(corpus_pipeline.near_dedup_stage(spark, docs, folder), "test")
    all_rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for _, t in all_rows]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    firsts = [all_rows[i] for i in sorted(set(root))]
    assert Counter(i for i, _ in firsts) == Counter(r["doc_id"] for r in deduped.collect()) and sum(i is None for i, _ in firsts) > 1


def test_pipeline_mixing(spark, null_and_repeated):
    folder, docs, items = null_and_repeated
    rows = corpus_pipeline._numbered(docs, "test").toPandas()
    mixed = mixing.mix(corpus_pipeline._numbered(docs, "test"), id_col="_row").collect()
    times = {r["_row"]: int(r["taken"] / max(1, r["size"]) + 0.5) for r in mixed}
    expected = Counter()
    for i, t, n in zip(rows["doc_id"], rows["text"], rows["_row"], strict=True):
        expected[None if i != i else int(i), t] += times[n]
    assert shown(corpus_pipeline.mixing_stage(spark, docs, folder)) == +expected


def test_places(spark, null_and_repeated):
    folder, docs, items = null_and_repeated
    clashing = docs.withColumn("_place", F.lit("x")).withColumn("_FILE", F.lit(1)).withColumn("_metadata", F.lit(2))
    made = spark.createDataFrame([(1, None), (None, "a b"), (None, "a b")], "doc_id long, text string")
    for d in (docs, clashing, made, made.where("doc_id > 1")):
        rows, place = corpus_pipeline._placed(d, "test")
        assert rows.columns == [*d.columns, place] and place not in d.columns
        again = corpus_pipeline._placed(d, "test")[0] if d is docs else rows
        seen = {r[place]: (r["doc_id"], r["text"]) for r in rows.collect()}
        assert len(seen) == d.count() and Counter(seen.values()) == shown(d)
        assert seen == {r[place]: (r["doc_id"], r["text"]) for r in again.repartition(3).collect()}


def test_columns_of_any_name_pass_through_every_stage(spark, null_and_repeated):
    folder, docs, items = null_and_repeated
    extra = {"_row": F.lit("r"), "_at": F.col("text"), "_times": F.lit(7), "_copy": F.lit(1.5), "_before": F.lit(2), "a.b": F.length("text"), "m": F.create_map(F.lit("k"), F.col("text")), "r": F.lit("x"), "part": F.lit(0)}
    wide = docs.withColumns(extra)
    seen = lambda df: Counter((r["doc_id"], r["text"], *(repr(r[c]) for c in extra)) for r in df.collect())
    all_rows = seen(wide)
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.near_dedup_stage, corpus_pipeline.decontamination_stage, corpus_pipeline.mixing_stage):
        out, plain = stage(spark, wide, folder), stage(spark, docs, folder)
        assert out.columns == wide.columns and set(seen(out)) <= set(all_rows)
        if stage is not corpus_pipeline.near_dedup_stage:  # of equal texts any may stay
            assert shown(out) == shown(plain)


def test_run_gives_the_ids_of_what_the_stages_leave(spark):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected, start = [], 0
    for i, t in sorted((r["doc_id"], r["text"] or "") for r in docs.collect()):
        ids = np.array([*tool.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(expected) and len(got) > 50
