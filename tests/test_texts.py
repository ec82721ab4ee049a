"""Sentence boundaries, the whole text chain and first bytes of files, against plain Python."""

import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabwarden.operators import sentences, text
from tabwarden.plans import catalog, texts
from tabwarden.sources import files

SF = "/root/testdata/sf0.001"
OPEN, CLOSE = r"""^["'(\[{“‘«„]+""", r"""["')\]}”’»“]+$"""


def core(w):
    return re.sub(CLOSE, "", re.sub(OPEN, "", w))


def kind(w):
    return re.sub(r"\.$", "", core(w).lower())


def likelihood(hits, of, share):
    p = min(max(share, 1e-12), 1 - 1e-12)
    return hits * math.log(p) + (of - hits) * math.log(1 - p)


def plain_model(all_texts):
    each = [t.split() for t in all_texts]
    dotted, bare = Counter(), Counter()
    for w in (w for ws in each for w in ws):
        (dotted if re.search(r"[^.]\.$", core(w)) else bare)[kind(w)] += 1
    n, dots = sum(dotted.values()) + sum(bare.values()), sum(dotted.values())
    short = {}
    for t, k in dotted.items():
        c, size = k + bare[t], max(len(t.replace(".", "")), 1)
        score = -2 * (likelihood(k, c, dots / n) - likelihood(k, c, 0.99)) * math.exp(-size) * (t.count(".") + 1) * float(size) ** -bare[t]
        if score >= 0.3 and re.search(r"[^\W\d_]", t):
            short[t] = score
    starts = Counter()
    for ws in each:
        for w, after in zip(ws, ws[1:], strict=False):
            if re.search(r"[!?]$", core(w)) or (re.search(r"[.]$", core(w)) and kind(w) not in short):
                if re.match(r"[^\W\d_]", kind(after)):
                    starts[kind(after)] += 1
    a, starters = sum(starts.values()), {}
    for t, ab in starts.items():
        b = dotted[t] + bare[t]
        p, p1, p2 = b / n, ab / a, (b - ab) / max(n - a, 1)
        score = -2 * (likelihood(ab, a, p) + likelihood(b - ab, n - a, p) - likelihood(ab, a, p1) - likelihood(b - ab, n - a, p2))
        if score >= 30 and p1 > p:
            starters[t] = score
    return short, starters


def plain_split(t, short, starters):
    if t is None or len(t.strip(" ")) < 5:
        return None if t is None else [t]
    out, now = [], []
    ws = re.sub(r'^"+|"+$', "", t).split()
    for i, w in enumerate(ws):
        now.append(w)
        if i + 1 < len(ws):
            c, after = core(w), core(ws[i + 1])
            upper = after[:1].isupper()
            if re.search("[!?]$", c):
                ends = True
            elif not re.search("[.…]$", c) or re.match(r"^[^\W\d_]\.$", c):
                ends = False
            elif re.match(r"^\d+\.$", c) or re.search(r"(\.\.|…)$", c):
                ends = upper
            else:
                ends = (upper and kind(ws[i + 1]) in starters) if kind(w) in short else True
            if ends:
                out.append(" ".join(now))
                now = []
    return out + ([" ".join(now)] if now else [])


@pytest.fixture(scope="module")
def docs(spark):
    """The documents, whatever white space of other alphabets replaced, and some letters with abbreviations."""
    more = [f"Mr. Hall met Dr. Kern at 5 p.m. on Monday. They spoke on Monday of e.g. rivers no. {i}. He left! \"Was it late?\" asked J. Smith." for i in range(60)]
    t = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.regexp_replace("text", r"[\x1c-\x1f\x85\p{Z}]", " ").alias("text"))
    return t.unionByName(spark.createDataFrame([*enumerate(more, 10**6), (1, None), (2, ""), (3, "a b"), (4, " . ")], "doc_id long, text string")).cache()


@pytest.fixture(scope="module")
def model(docs):
    return sentences.learn(docs, "text")


def test_learned_model_is_the_plain_one(docs, model):
    short, starters = plain_model([r["text"] for r in docs.collect() if r["text"] is not None])
    assert {r["type"]: r["score"] for r in model.abbreviations.collect()} == pytest.approx(short, rel=1e-6)
    assert {r["type"]: r["score"] for r in model.starters.collect()} == pytest.approx(starters, rel=1e-6)
    assert {"mr", "dr", "p.m", "e.g"} <= set(short)


@pytest.mark.parametrize("block", [50_000, 5])
def test_boundaries_are_the_plain_ones(docs, model, block, monkeypatch):
    monkeypatch.setattr(sentences, "BLOCK", block)
    short, starters = ({r["type"] for r in t.collect()} for t in (model.abbreviations, model.starters))
    rows = sentences.split(docs.where("doc_id < 4 OR doc_id >= 1000000" if block == 5 else "true"), "text", model).collect()
    for r in rows:
        assert r["sentences"] == plain_split(r["text"], short, starters)
    letter = next(r["sentences"] for r in rows if r["doc_id"] == 10**6)
    assert letter[0] == "Mr. Hall met Dr. Kern at 5 p.m. on Monday." and letter[-1].endswith("asked J. Smith.")


def test_sentences_learned(spark):
    """The query is the learned split of the documents, with their own white space."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short, starters = plain_model([r["text"] for r in rows if r["text"] is not None])
    got = {r["doc_id"]: r["sentences"] for r in catalog.QUERIES["sentences_learned"](spark, SF).collect()}
    ascii_only = [r for r in rows if r["text"] is not None and not re.search(r"[\x1c-\x1f\x85\xa0\u2000-\u3000]", r["text"])]
    assert len(got) == len(rows) and len(ascii_only) > 100
    for r in ascii_only:
        assert got[r["doc_id"]] == plain_split(r["text"], short, starters)


def test_chain_leaves_the_fields_of_all_steps(spark):
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    known = spark.createDataFrame([(w, 50) for w in "the river runs through town people walk along it in evening and they are glad".split()], "word string, n long")
    said = ["The rivre runs thruogh the town and people walk along it.", "<b>The river</b> runs. People are glad! They walk.", "El rio corre por la ciudad y la gente camina por la noche. Es muy largo y ancho.", "", None, "12 34", "Mail bob@mail.com and the people walk along the river in the evening"]
    df = spark.createDataFrame([(i % 3, t, "x") for i, t in enumerate(said)], "doc_id long, text string, language_hint string")
    out = text.run_chain(df, "text", known, text.language_profile(whole, "text", "lang"), sentences.learn(whole, "text"))
    got = {r["text"]: r for r in out.collect()}
    assert set(got) == set(said) and out.count() == len(said)
    a, b, c, d, e, f, g = (got[t] for t in said)
    assert a["clean_text"] == "The river runs through the town and people walk along it." and "spelling" in a["steps_run"] and a["language"] == "en"
    assert b["clean_text"] == "The river runs. People are glad! They walk." and b["sentences"] == ["The river runs.", "People are glad!", "They walk."] and b["steps_run"][0] == "html_strip" and b["confidence"] == 0.95
    assert c["language"] == "es" and c["clean_text"] == said[2] and "spelling" not in c["steps_run"] and len(c["sentences"]) == 2
    assert (d["status"], e["status"]) == ("failed", "failed") and "no text" in d["errors"] and not d["is_valid"]
    assert f["status"] == "partial" and f["errors"] == ["no language"] and f["tokens"] == ["12", "34"] and f["language"] == "unknown"
    assert g["entities"] == ["EMAIL:bob@mail.com"] and "entities" in g["steps_run"] and g["status"] == "cleaned"
    assert all(set(r["steps_run"]) <= set(r["steps"]) for r in got.values())


def test_chain_query_agrees_with_the_operators(spark):
    rows = {(r["conv_id"], r["turn"], r["role"], r["text"]): r for r in catalog.QUERIES["text_chain"](spark, SF).collect()}
    talk = spark.read.parquet(f"{SF}/conversations.parquet")
    assert len(rows) == talk.distinct().count()
    plans = {tuple(r)[:-1]: r["p"] for r in talk.select("conv_id", "turn", "role", "text", F.array_join(text.ordered_plan(text.plan(F.col("text"))), "|").alias("p")).collect()}
    assert {k: r["steps"] for k, r in rows.items()} == plans
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    numbered = talk.withColumn("id", F.xxhash64("conv_id", "turn", "role", "text")).withColumn("clean", text.strip_html(F.col("text")))
    langs = text.detect_language(numbered.select("id", "clean"), "id", "clean", text.language_profile(whole, "text", "lang"))
    for r in numbered.join(langs, "id").collect():
        own = rows[r["conv_id"], r["turn"], r["role"], r["text"]]
        assert own["language"] == (r["lang"] if "language" in own["steps"] else "unknown")
        if "spelling" not in own["steps_run"]:
            assert own["clean_text"] == r["clean"]
    tokens = texts.text.tokens(F.col("t"))
    pairs = spark.createDataFrame([(r["clean_text"], r["tokens"]) for r in rows.values()], "t string, tokens string")
    assert pairs.where(F.array_join(tokens, "|") != F.col("tokens")).count() == 0


def test_first_bytes_of_files_of_any_size(spark, tmp_path):
    with open(tmp_path / "big one.xls", "wb") as f:
        f.write(bytes.fromhex("d0cf11e0a1b11ae1") + b"x" * 2000)
        f.truncate(3 << 30)  # sparse, over what a row can hold
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "ü.txt").write_text("<TABLE>" + "y" * 5000)
    heads = {os.path.basename(r["path"]): (r["length"], len(r["head"])) for r in files.file_heads(spark, str(tmp_path)).collect()}
    assert {k.replace("%20", " "): v for k, v in heads.items()} == {"big one.xls": (3 << 30, 512), "ü.txt": (5007, 512)}
    assert {r["name"].replace("%20", " "): r["kind"] for r in files.sniff(spark, str(tmp_path)).collect()} == {"big one.xls": "ole2", "ü.txt": "html"}


def test_files_as_texts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"b":1,"a":["é"]}')
    (tmp_path / "b.csv").write_text("name,n\nlong name,7\n")
    (tmp_path / "c.txt").write_text("as it is\n")
    (tmp_path / "d.json").write_text("{broken")
    got = {os.path.basename(r["path"]): r["text"] for r in files.read_as_text(spark, str(tmp_path)).collect()}
    assert got == {"a.json": '{\n  "b": 1,\n  "a": [\n    "é"\n  ]\n}', "b.csv": "     name  n\nlong name  7", "c.txt": "as it is\n", "d.json": "{broken"}


def test_languages_carried_and_joined_are_those_of_naive_bayes(spark, monkeypatch):
    """Each row by its own text, whatever its id; a profile that tasks carry needs no shuffle of n-grams."""
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    profile = text.language_profile(whole, "text", "lang")
    said = [(1, "The river runs through the town"), (1, "El río corre por la ciudad y la noche"), (None, "das Wasser fließt und die Leute"), (2, "xx"), (3, None), (4, "12 34"), (5, "日本語の文"), (6, "ÉTÉ: à la maison")]
    said += [(i + 10, r["text"]) for i, r in enumerate(whole.select("text").collect())]
    docs = spark.createDataFrame(said, "id long, text string")
    counts = {(r["lang"], r["gram"]): r["n"] for r in profile.collect()}
    langs = sorted({k for k, _ in counts})
    loss = {k: math.log(sum(n for (x, _), n in counts.items() if x == k) + sum(x == k for x, _ in counts)) for k in langs}

    def plain(t):
        if t is None or len(t) < 3 or not re.search(r"[^\W\d_]", t):
            return "unknown"
        grams = [p[i : i + 3] for w in re.findall(r"[^\W\d_]+", t.lower()) for p in [f"_{w}_"] for i in range(max(1, len(p) - 2))]
        gain = {k: sum(math.log(counts[k, g] + 1) for g in grams if (k, g) in counts) for k in langs}
        return max(((gain[k] - len(grams) * loss[k], k) for k in langs if gain[k] > 0), default=(0, "unknown"))[1]

    want = sorted((str(i), plain(t)) for i, t in said)
    found = text.detect_language(docs, "id", "text", profile)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r["id"]), r["lang"]) for r in found.collect()) == want
    monkeypatch.setattr(text, "CARRIED", 0)
    assert sorted((str(r["id"]), r["lang"]) for r in text.detect_language(docs, "id", "text", profile).collect()) == want
    monkeypatch.undo()
    monkeypatch.setattr(text, "WORDS", 3)
    assert sorted((str(r["id"]), r["lang"]) for r in text.detect_language(docs, "id", "text", profile).collect()) == want


def test_words_are_looked_up_without_going_through_all_starters_for_each_row(spark, docs, model, monkeypatch):
    """No row is joined with whole lists; marks of any kind within a word cut nothing; a lookup in several blocks is that in one."""
    said = [(1, "One\x01word is here. \x0b\x0b He left at 5 p.m. \t on Monday.  They met Dr.\n Hall (\"why?\") Then... they left."), (2, None), (3, " \n "), (4, '"""'), (5, "Is it so?! Yes… No. 7. They"), (6, "x" * 20000 + "." * 20000 + " End")]
    own = spark.createDataFrame(said, "doc_id long, text string")
    short, starters = ({r["type"] for r in t.collect()} for t in (model.abbreviations, model.starters))
    found = sentences.split(own, "text", model)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r["sentences"] for r in found.collect()}
    assert got[1][0] == "One\x01word is here."
    for i in (2, 3, 4, 5, 6):
        assert got[i] == plain_split(dict(said)[i], short, starters)
    monkeypatch.setattr(sentences, "BLOCK", 5)
    assert {r["doc_id"]: r["sentences"] for r in sentences.split(own, "text", model).collect()} == got


def test_chain_learns_its_dictionary_once(spark):
    """Steps read the words from a table of them; the texts that they came from are not counted again for each."""
    counted = spark.sparkContext.accumulator(0)

    def seen(batches):
        counted.add(1)
        yield from batches

    words_ = [(w, 50) for w in "the river runs through town and people walk along it".split()]
    known = spark.createDataFrame(words_, "word string, n long").coalesce(1).mapInArrow(seen, "word string, n long")
    whole = spark.createDataFrame([("the river runs through the town and people walk along it. They are glad.", "en")], "text string, lang string")
    df = spark.createDataFrame([(1, "The rivre runs thruogh the town and people walk along it.")], "id long, text string")
    out = text.run_chain(df, "text", known, text.language_profile(whole, "text", "lang"), sentences.learn(whole, "text")).collect()
    assert out[0]["clean_text"] == "The river runs through the town and people walk along it."
    assert counted.value == 1
