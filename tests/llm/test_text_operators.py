"""Token counts, byte pairs, quality, language and licenses against plain versions and the tokenizers' libraries."""

import collections
import functools
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from fixtures import LONG, LOWER, base_measures, empty, messy, messy_rows, prose, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contractspark.llm import byte_bpe, language, licenses, quality, token_counts
from contractspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VOCABULARY, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
ALPHABET = "aAbBÉéΣσς'sSdllm  \t\n\x1c\x1d\x85\u3000 日本語İıß１²½ ́éñ!?.,\U0001F600ﬁǅ"


@pytest.fixture(scope="module")
def strange():
    rng = random.Random(3)
    made = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(3000)]
    return [*made, "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|", "a" * 5000, "ab " * 3000, LONG]


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_word_counts_equal_the_library(strange):
    counter = token_counts.WordCounter(open(VOCABULARY, encoding="utf-8").read())
    library = Tokenizer.from_file(VOCABULARY)
    assert [counter.count(t) for t in strange] == [len(library.encode(t, add_special_tokens=False).ids) for t in strange]


@pytest.fixture(scope="module")
def pairs():
    return byte_bpe.BytePairs(open(RANKS, "rb").read(), P.PATTERN)


def test_perfect_hash_is_minimal_and_exact(pairs):
    assert all(pairs.whole.get(k) == v for k, v in pairs.ranks.items())
    assert pairs.whole.n == len(pairs.ranks) and all(pairs.whole.get(x) is None for x in (b"", b"qqqzzz", b"\xff" * 9))


def test_byte_pairs_equal_the_library_and_round_trip(pairs, strange):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    for t in [*strange, "a  b", "a \n b ", "x\n  y", " lead", "\xa0 b"]:
        ids = pairs.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert pairs.decode(ids) == t.encode()


def test_byte_pairs_at_mixed_white_space(pairs):
    """Spaces beside other white space belong to its run; parts between single spaces are remembered apart."""
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    draw = random.Random(11)
    marks = [" ", "\n", "\t", "\xa0", "\u3000", "\x1c", "a", "word", "'s", "1", "\u00e9", ",", "'"]
    texts = ["\n\t1 \xa0 \xa0\u30001word", "a\n \nb", "x \n \n y", " a", "a ", " \n", "word word, word,'s"]
    for text in texts + ["".join(draw.choice(marks) for _ in range(draw.randrange(14))) for _ in range(5000)]:
        assert np.frombuffer(pairs.encode(text), "<u4").tolist() == library.encode_ordinary(text), text


def test_op2_and_op8_on_a_table(spark, documents, pairs):
    library = Tokenizer.from_file(VOCABULARY)
    for r in QUERIES["op2_token_counts"](spark, SF).collect():
        text = documents[r.doc_id]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
    for r in QUERIES["op8_byte_bpe"](spark, SF).collect():
        ids = pairs.encode(documents[r.doc_id])
        want = len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(documents[r.doc_id].encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_tokens_of_awkward_rows(spark):
    got = token_counts.count_tokens(messy(spark), VOCABULARY, 5).collect()
    assert len(got) == len(messy_rows()) and sorted(r.n_tokens for r in got)[:4] == [0] * 4
    coded = byte_bpe.decode(byte_bpe.encode(messy(spark), RANKS, P.PATTERN, ids_column="made"), RANKS, P.PATTERN, "made")
    assert coded.columns == [c for c in messy(spark).columns if c != "made"] + ["made", "decoded"]
    assert all(r.decoded == (r.text or "").encode() for r in coded.collect())
    arrays = byte_bpe.ids_array(byte_bpe.encode(messy(spark), RANKS, P.PATTERN)).select("text", "ids").collect()
    assert all((not r.text) == (len(r.ids) == 0) for r in arrays)
    assert token_counts.count_tokens(empty(spark), VOCABULARY, 5).count() == 0
    assert byte_bpe.encode(empty(spark), RANKS, P.PATTERN).count() == 0


# ---- quality ---------------------------------------------------------------------------------------------
def test_measures(spark):
    odd = [(i, t) for i, t in enumerate(["a b c d e f g h " * 3, "x " * 40, "p\np\n\np\n q", "# * a\x1cb |", "é" * 9 + " ü"])]
    frame = messy(spark).select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    for r in quality.with_measures(frame).select("row.text", *quality.MEASURES).collect():
        assert tuple(r)[1:] == base_measures(r.text), r.text


def test_op3_on_a_table(spark, documents):
    rows = QUERIES["op3_quality_rules"](spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        want = base_measures(documents[r.doc_id])
        assert tuple(r[c] for c in quality.MEASURES) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert 0 <= r.quality <= 1 and not (r.kept and r.base_failed)
    kept = {r.doc_id: r.kept for r in rows}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [kept[d] == (q == 1) for d, q in truth.items() if d in kept and not next(r for r in rows if r.doc_id == d).base_failed]
    assert np.mean(right) > 0.9


def test_em_weighs_rules_and_keeps_rows_whole(spark):
    good = [(i, prose(i), "x") for i in range(60)]
    bad = [(100 + i, " ".join(w + "%%%" for w in prose(i).split()), "x") for i in range(8)]
    kept = quality.keep_good(spark.createDataFrame(good + bad, "doc_id long, text string, n_words string"))
    assert kept.columns == ["doc_id", "text", "n_words"]
    assert {r.doc_id for r in kept.collect()} == set(range(60))
    assert quality.keep_good(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).columns == empty(spark).columns
    assert all(r.text for r in quality.keep_good(messy(spark)).collect())


def test_quality_runs_without_python_on_the_executors(spark):
    plan = quality.judge(quality.with_measures(messy(spark)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- language --------------------------------------------------------------------------------------------
def test_language_held_out(spark):
    rows = QUERIES["op4_language_id"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    joined = rows.join(truth, "doc_id").where("held_out").collect()
    assert len(joined) > 20 and np.mean([r.lang == r.lang_pred for r in joined]) > 0.97


def test_language_of_awkward_rows(spark):
    model = language.fit(messy(spark))
    assert model.languages == ["de", "en", "fr", "ja"]
    got = language.identify(messy(spark), model, ["doc_id", "fp"]).collect()
    assert len(got) == len(messy_rows()) and all(0 <= r.score <= 1 for r in got)
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.lang_pred)
    assert by_id[0] == by_id[1] == by_id[2] == by_id[8] == {"und"} and by_id[7] == {"ja"}
    none = language.fit(empty(spark))
    assert none.languages == [] and {r.lang_pred for r in language.identify(messy(spark), none, ["doc_id"]).collect()} == {"und"}


def test_batches_don_t_change_predictions(spark):
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()] + ["", LONG * 3]
    together = model.predict(texts)[0]
    assert together == [model.predict([t])[0][0] for t in texts]


# ---- licenses --------------------------------------------------------------------------------------------
def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def places(text):
    w, found = plain_words(text), []
    for label, phrase in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return w, found


def test_op10_on_a_table(spark, documents):
    for r in QUERIES["op10_license_scans"](spark, SF).collect():
        w, found = places(documents[r.doc_id])
        starts, labels = [i for i, _ in found], {x for _, x in found}
        want = len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_rules_and_overlaps(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0": {"apache", "apache-2.0"},
        "mit license mit license": {"mit"},
        "SPDX-License-Identifier: GPL-3.0-only": {"gpl-3.0"},
        "released under the 3-clause BSD license": {"bsd-3-clause"},
        "GNU Lesser General Public License": {"gpl", "lgpl"},
        "He came mit dem Zug; she has no permission.": set(),
        "Creative Commons Attribution-ShareAlike": {"cc-by-sa"},
    }
    rows = licenses.scan_licenses(spark.createDataFrame([(t,) for t in cases], "text string")).collect()
    assert {r.row.text: set(r.labels) for r in rows} == cases
    assert next(len(r.base_spans) for r in rows if r.row.text.startswith("mit license mit")) == 2
    assert len(licenses.rules()) > 300


def sample(parsed, short=True):
    """A text that a rule's pattern matches: first branches; optional parts left out, or once each."""
    made = ""
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            made += chr(value)
        elif name == "IN":
            made += chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])
        elif name == "ANY":
            made += "x"
        elif name == "SUBPATTERN":
            made += sample(value[3], short)
        elif name == "BRANCH":
            made += sample(value[1][0], short)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            made += sample(value[2], short) * (value[0] if short else max(1, value[0]))
    return made


compiled = functools.cache(re.compile)  # re's own cache is smaller than the list of rules


def plain_labels(text, signatures):
    """All places of all rules, less those inside a place of the same or a higher priority."""
    form, found = " ".join(plain_words(text)), set()
    for r in signatures:
        for m in compiled(r["pattern"]).finditer(form):
            start = form[: m.start()].count(" ")
            found.add((start, start + m[0].count(" ") + 1, r["priority"], r["label"], r["rule"]))
    inside = lambda a, b: b is not a and b[0] <= a[0] and a[1] <= b[1] and b[2] >= a[2]
    order = lambda s: (s[0], -s[1], -s[2], s[4])
    kept = [a for a in found if a[2] == licenses.BASE_PRIORITY or not any(inside(a, b) and (b[:3] != a[:3] or order(b) < order(a)) for b in found)]
    return {a[3] for a in kept}


def test_every_rule_is_found_however_it_is_wrapped(spark):
    signatures = licenses.rules()
    texts = sorted({sample(re._parser.parse(r["pattern"]), short) for r in signatures for short in (True, False)})
    assert len(signatures) > 500 and len(texts) > 800
    for r in signatures:  # what lets a rule be tried is part of what it looks for
        for text in (f" {sample(re._parser.parse(r['pattern']), short)} " for short in (True, False)):
            assert " " + r["keyword"] in text and " " + r["anchor"] in text and r["anchor"] in licenses.ANCHORS, r
    forms = ["\n".join, "\n * ".join, "\r\n//  ".join, " ... ".join, lambda w: " ".join(w).upper()]
    rows = [(i, forms[i % len(forms)](text.split(" "))) for i, text in enumerate(texts)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "i long, text string").repartition(16)).collect()
    want = {i: plain_labels(t, signatures) for i, t in enumerate(texts)}
    for r in got:
        assert set(r.labels) == want[r.row.i] and r.labels, r.row.text


def test_labels_equal_a_plain_scan_of_a_table(spark, documents):
    signatures = licenses.rules()
    extra = "Copyright (c) 2020\nAll rights\n reserved. Released\n# under the MIT\n# license; MIT licence. Placed in the public\ndomain."
    texts = [*documents.values(), extra, extra.replace("\n", " ")]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).collect()
    assert {r.row.i: set(r.labels) for r in rows} == {i: plain_labels(t, signatures) for i, t in enumerate(texts)}


def test_licenses_of_awkward_rows(spark):
    got = licenses.scan_licenses(messy(spark))
    assert got.count() == len(messy_rows()) and licenses.scan_licenses(empty(spark)).count() == 0
    for r in got.select("row.text", "n_words", F.size("base_spans").alias("n")).collect():
        w, found = places(r.text)
        assert (r.n_words, r.n) == (len(w), len(found))
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())
