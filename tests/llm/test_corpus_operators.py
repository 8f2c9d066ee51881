"""Near-duplicates, fingerprints, personal data, chat windows, mixing and the pipeline against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from fixtures import LONG, LOWER, empty, messy, messy_rows, prose, words
from pyspark.sql import functions as F

import corpus_pipeline
from contractspark.llm import boosting, byte_bpe, chat, mixing, pii, simhash, weighted_sampling
from contractspark.llm.common import stage
from contractspark.llm.queries import QUERIES, TRICKY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# ---- near-duplicates ---------------------------------------------------------------------------------------
def plain_fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints: list[int], distance: int) -> list[int]:
    """Index of the first member of each entry's class."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    codes = np.array(prints, np.uint64)
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= distance):
            a, b = sorted((root(i), root(i + 1 + int(j))))
            parent[b] = a
    return [root(i) for i in range(len(codes))]


def test_op1_on_a_table(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op1_simhash_dedup"](spark, SF).collect()}
    ids = sorted(documents)
    prints = [plain_fingerprint(documents[i]) for i in ids]
    assert [rows[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [rows[i].component_id for i in ids] == [ids[k] for k in plain_classes(prints, 4)]


@pytest.mark.parametrize("hot, blocks", [(simhash.HOT, 6), (3, 6), (simhash.HOT, 7), (20, 5)])
def test_links_are_whole(spark, hot, blocks):
    """Dense balls, chains and far codes, in usual and in hot cells."""
    rng = random.Random(5)
    codes = {rng.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1}
    centre = rng.getrandbits(64)
    codes |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(120)}
    chain = rng.getrandbits(64)
    for step in range(30):
        codes.add(chain)
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    frame = spark.createDataFrame([(c,) for c in signed], "fp long")
    labels = {r.u: r.label for r in simhash.components(simhash.links(frame, 4, hot, blocks)).collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for c in signed:
        got[labels.get(c, c)].add(c)
    for c, k in zip(signed, plain_classes(codes, 4)):
        want[k].add(c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_gray_rank_and_index():
    order = simhash.gray_rank(np.array([i ^ (i >> 1) for i in range(64)], np.uint64))
    assert order.tolist() == list(range(64))
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    runs = np.repeat([0, 1], [len(codes) // 2, len(codes) - len(codes) // 2])
    a, b = simhash.GrayIndex(codes, runs).links(np.arange(len(codes)), 2)
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if runs[i] == runs[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_near_duplicates_of_awkward_rows(spark):
    got = simhash.near_duplicates(messy(spark), 4, 4).collect()
    assert len(got) == len(messy_rows())
    empty_ones = [r for r in got if r.fp == 0]
    assert len(empty_ones) == 5 and {r.component_id for r in empty_ones} == {0} and sum(r.is_first for r in empty_ones) == 1
    assert sum(r.is_first for r in got) == len({r.component_id for r in got if r.component_id is not None}) + len({r.fp for r in got if r.component_id is None})
    dropped = simhash.drop_near_duplicates(messy(spark), 4, 4)
    assert dropped.columns == messy(spark).columns and dropped.count() == sum(r.is_first for r in got)
    assert simhash.near_duplicates(empty(spark), 4, 4).count() == 0


# ---- fingerprints ----------------------------------------------------------------------------------------
def generalised_jaccard(a, b):
    a, b = collections.Counter(a.split()), collections.Counter(b.split())
    every = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in every) / sum(max(a[k], b[k]) for k in every)


def test_op5_on_a_table(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op5_document_fingerprints"](spark, SF).collect()}
    ids = sorted(documents, reverse=True)
    errors = []
    for d, following in zip(ids, ids[1:] + ids[:1]):
        text, r = documents[d], rows[d]
        half = len(text) // 2
        changed = text[: len(text) - half] + documents[following][:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        own, other = bytes.fromhex(r.fingerprint), bytes.fromhex(rows[following].fingerprint)
        assert r.near_next == weighted_sampling.likeness(own, other)
        assert r.near_edited == weighted_sampling.likeness(own, bytes.fromhex(r.edited_fingerprint))
        errors.append(r.near_edited - generalised_jaccard(text, changed))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.09


def test_collision_rate_is_generalised_jaccard():
    sampler = weighted_sampling.Sampler(4096)
    a, b = "x " * 6 + "y " * 2 + "z only", "x " * 3 + "y " * 5 + "w"
    got = weighted_sampling.likeness(sampler.signature(a), sampler.signature(b))
    assert abs(got - generalised_jaccard(a, b)) < 0.03
    assert sampler.signature(a) == sampler.signature(" ".join(sorted(a.split())))


def test_fingerprints_of_awkward_rows(spark):
    got = weighted_sampling.compare_with_next(messy(spark).repartition(5)).collect()
    rows = sorted(((r[0], r[1] or "") for r in messy_rows()), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows) and collections.Counter((r.doc_id, r.n_chars) for r in got) == collections.Counter((i, len(t)) for i, t in rows)
    assert weighted_sampling.compare_with_next(empty(spark)).count() == 0
    alone = weighted_sampling.compare_with_next(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()
    assert [(r.near_next, r.edited_sha256) for r in alone] == [(1.0, hashlib.sha256(b"a a").hexdigest())]


# ---- personal data ---------------------------------------------------------------------------------------
def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = digits(m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_strict_spans_equal_the_plain_patterns(documents):
    rng = random.Random(2)
    made = ["".join(rng.choices("0123456789" * 2 + ".@+- ()ab_%é\n", k=rng.randint(0, 60))) for _ in range(20_000)]
    for t in [*documents.values(), *made, "4619646426088949 4619646426088949", "1.2.3.4.5.6.7.8", "a@b.co_x@d.ef", "a@b@c.de"]:
        assert [(s.start, s.kind, s.end) for s in pii.strict_spans(t)] == plain_spans(t)
    pii.strict_spans("1" * 200_000 + "a" * 200_000 + "@"), pii.strict_spans("+1" * 100_000)  # no quadratic search


def test_trees_learn_other_forms(spark):
    model = pii.fit(spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    found = lambda t: [(pii.KINDS[s.kind], t[s.start : s.end]) for s in model.spans(t)]
    assert found("Call me at (212) 555-1234 please") == [("phone", "(212) 555-1234")]
    assert found("card 4111.1111.1111.1111 thanks") == [("card", "4111.1111.1111.1111")]
    for clean in ("on 2024-05-06 we met", "pages 100-200 and 300-400", "isbn 978-3-16-148410-0", "in 1990 and 2004"):
        assert found(clean) == []
    assert pii.redacted("mail a@b.co now", model.spans("mail a@b.co now")) == "mail [EMAIL] now"


def test_op6_learns_from_every_text_alike_in_the_driver_and_by_jobs(spark, monkeypatch):
    bodies = spark.range(9000).select(
        F.concat(F.lit("item "), F.col("id"), F.lit(" of the list")).alias("plain"), F.concat(F.lit("card 4111 1111 1111 1111 row "), F.col("id")).alias("card")
    )
    plain = bodies.select(F.col("plain").alias("text")).where(F.xxhash64("text") < 0)
    cards = bodies.select(F.col("card").alias("text")).where(F.xxhash64("text") >= 0).limit(300)
    docs = plain.unionByName(cards).unionByName(cards)  # copies count once
    assert plain.count() > 2000  # all of these have smaller hashes
    expected = sum(1 for r in cards.collect() for _ in pii.labelled(r.text))
    assert pii.labelled_rows(docs).agg(F.sum("n")).first()[0] == expected
    model = pii.fit(docs, rounds=4)
    assert model.trees.leaf and model.thresholds[2] < 1
    monkeypatch.setattr(pii, "LOCAL_ROWS", 0)
    other = pii.fit(docs, rounds=4)
    assert other.thresholds == model.thresholds and all((a == b).all() for a, b in zip(model.trees.limit + model.trees.leaf, other.trees.limit + other.trees.leaf))


def test_pii_of_very_many_spans_in_a_text(spark):
    text = "a@b.co 4111 1111 1111 1111, 212-555-1234; " * 4_000
    assert sum(1 for _ in pii.labelled(text)) > 20_000  # no copy of the text, no pass over all spans, for each
    assert pii.strict_spans("0" * 5000 + "1.2.3.4") == [pii.Span(1, 0, 5007)]


def test_boosting_and_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((boosting.fit(x, y).probability(x) > 0.5) == y).mean() > 0.97
    assert boosting.calibrated(np.array([0.9, 0.8, 0.7]), np.array([1.0, 1, 0]), 0.99, 0.5) == 0.8
    assert boosting.calibrated(np.zeros(0), np.zeros(0), 0.99, 0.5) == 1.0


def test_op6_on_a_table_and_awkward_rows(spark, documents):
    for r in QUERIES["op6_pii"](spark, SF).collect():
        base = plain_spans(documents[r.doc_id])
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
    model = pii.fit(messy(spark))
    assert pii.find_spans(messy(spark), model, ["doc_id", "row"]).count() == len(messy_rows())
    safe = pii.redact(messy(spark), model)
    assert safe.columns == messy(spark).columns
    texts = {r.doc_id: r for r in safe.collect()}
    assert texts[6].text.startswith("Mail [EMAIL] or [PHONE], host [IP], card [CARD]") and texts[6].n_chars == len(texts[6].text)
    assert texts[0].text is None and pii.redact(empty(spark), pii.fit(empty(spark))).count() == 0


# ---- chat --------------------------------------------------------------------------------------------------
def test_op7_on_a_table(spark):
    turns = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()] + TRICKY
    said = collections.defaultdict(list)
    for conv, _, role, text in sorted(turns):
        said[conv].append((role, text))
    rows = QUERIES["op7_chat_windows"](spark, SF).collect()
    assert {r.conv_id for r in rows} == set(said) and len(rows) == len(said)
    for r in rows:
        loss = "".join(t for role, t in said[r.conv_id] if role == "assistant")
        turned = "".join(f"{role}\n{t}\n" for role, t in said[r.conv_id])
        want = len(said[r.conv_id]), hashlib.sha256(turned.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want


def test_windows_keep_budget_system_and_order(spark):
    body = [(1, i, "user" if i % 2 else "assistant", " ".join(f"w{i}_{k}" for k in range(i * 37 % 90))) for i in range(1, 700)]
    rows = [(1, 0, "system", "be kind"), *body, (1, 700, "user", "x " * 900), (1, 701, "assistant", "y")]
    odd = [(None, None, None, None), (2, None, "a:\\;b\\", "\\;###\n####</turn>\n"), (2, 1, "assistant", ""), (2, 1, "assistant", "")]
    frame = spark.createDataFrame(rows + odd, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(frame, budget=400, history=60)
    seen = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(seen) > 30 and all(w.formatted.startswith("### system:\nbe kind</turn>\n") for w in seen)
    assert sum(w.n_tokens > 400 + 6 for w in seen) == 1  # the turn of 900 words
    assert max(w.n_context for w in seen) > 1
    back = collections.defaultdict(list)
    for w in chat.read_back(windows).orderBy("window").collect():
        back[w.conv_id] += [(t.role, t.text) for t in w.turns]
    assert back[1] == [(role, text) for _, _, role, text in rows]
    assert back[2] == [("assistant", ""), ("assistant", ""), ("a:\\;b\\", "\\;###\n####</turn>\n")] and back[None] == [("", "")]
    assert chat.digests(chat.read_back(chat.format_windows(frame.limit(0)))).count() == 0


# ---- mixing --------------------------------------------------------------------------------------------------
def plain_targets(sizes: dict) -> dict:
    total, capped = sum(sizes.values()), set()
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    while True:
        open_ = [s for s in sizes if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in sizes}
        capped |= over


def test_targets(spark):
    for sizes in ({"a": 10.0, "b": 1000.0, None: 30.0, "c": 0.0, "d": 500.0}, {"a": 5.0}, {"x": 0.0, "y": 0.0}, {chr(97 + i): float(i**3) for i in range(20)}):
        frame = spark.createDataFrame([(s, v, 1) for s, v in sizes.items()], "source string, source_size double, n long")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_flight_keeps_totals_and_expectations():
    rng = random.Random(1)
    sizes = [float(rng.randrange(1, 900)) for _ in range(400)]
    for _ in range(5):
        p = [rng.random() for _ in sizes]
        after = mixing.flight(p, sizes, rng)
        assert sum(0 < q < 1 for q in after) <= 2
        assert sum(after) == pytest.approx(sum(p)) and sum(map(float.__mul__, after, sizes)) == pytest.approx(sum(map(float.__mul__, p, sizes)))
        landed = mixing.flown_and_landed(p, sizes, rng)
        assert set(landed) <= {0.0, 1.0} and abs(sum(map(float.__mul__, landed, sizes)) - sum(map(float.__mul__, p, sizes))) < 30
    ends = [mixing.flight([0.3] * 12, sizes[:12], random.Random(i)) for i in range(600)]
    assert np.mean(ends, axis=0) == pytest.approx([0.3] * 12, abs=0.1)


def test_op9_on_a_table(spark, documents):
    rows = QUERIES["op9_mixing"](spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").toPandas()
    joined = rows.merge(truth, on="doc_id")
    assert (joined["size"] == [len(words(documents[d])) for d in joined.doc_id]).all() and len(joined) == len(documents)
    by = joined.groupby("source").agg(total=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert (by.total == by.said).all() and by.target.to_dict() == pytest.approx(plain_targets(by.total.astype(float).to_dict()))
    assert (joined.taken <= 3 * joined["size"]).all() and ((by.taken - by.target).abs() <= by.most).all()
    again = QUERIES["op9_mixing"](spark, SF).toPandas()
    pick = lambda f: f.sort_values("doc_id").reset_index(drop=True)
    assert pick(rows).equals(pick(again))


def test_many_blocks_keep_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    monkeypatch.setattr(mixing, "MERGE", 3)
    monkeypatch.setattr(mixing, "WAITING", 30)
    rng = random.Random(9)
    docs = [(i, " ".join(["w"] * rng.randrange(1, 200)), rng.choice(["hot", "hot", "hot", "b", None])) for i in range(1500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(stage(mixing.sized(frame, F.lit(0)), "sizes")).toPandas()
    assert sorted(rows.id) == list(range(1500))
    for _, own in rows.groupby("source", dropna=False):
        assert abs((own["size"] * own.copies).sum() - own.target.iloc[0]) < 20


def test_mixing_of_awkward_rows(spark):
    rows = mixing.mix(stage(mixing.sized(messy(spark), F.lit(0)), "sizes"))
    assert rows.count() == len(messy_rows()) and rows.agg(F.max("copies")).first()[0] <= 3
    assert mixing.mixed(messy(spark)).columns == messy(spark).columns and mixing.mixed(empty(spark)).count() == 0


# ---- pipeline --------------------------------------------------------------------------------------------------
def test_pipeline_stage_by_stage(spark):
    """Each stage against what its predecessor kept."""
    good = [(i, prose(i, 60 + i % 40)) for i in range(40)]
    copies = [(100 + i, prose(i, 60 + i % 40)) for i in range(5)]
    junk = [(200 + i, "spam spam spam spam spam spam spam spam " * 5) for i in range(4)]
    private = [(300, prose(300) + " Write to ann@example.com.")]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in good + copies + junk + private]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(good + copies + private)
    quality, dedup, redact, mix, encode = (f for _, f in corpus_pipeline.STAGES)
    after = stage(quality(spark, docs, SF), "t")
    assert {r.doc_id: r.text for r in after.collect()} == kept and after.columns == docs.columns
    after = stage(dedup(spark, after, SF), "t")
    ids = sorted(kept)
    firsts = {ids[k] for k in plain_classes([plain_fingerprint(kept[i]) for i in ids], 4)}
    assert {r.doc_id for r in after.collect()} == firsts and after.columns == docs.columns
    after = stage(redact(spark, after, SF), "t")
    texts = {r.doc_id: r.text for r in after.collect()}
    assert set(texts) == firsts and texts[300].endswith("Write to [EMAIL].") and all(texts[i] == kept[i] for i in firsts - {300})
    mixed = stage(mix(spark, after, SF), "t")
    n = collections.Counter(r.doc_id for r in mixed.collect())
    assert max(n.values()) <= 3 and set(n) <= firsts and mixed.columns == docs.columns
    coded = encode(spark, mixed, SF).collect()
    pairs = byte_bpe.BytePairs(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    assert collections.Counter(r.doc_id for r in coded) == n
    assert all(r.ids == pairs.encode(texts[r.doc_id]) and r.n_tokens * 4 == len(r.ids) for r in coded)


def test_pipeline_of_awkward_rows(spark):
    for rows in (messy(spark), empty(spark)):
        docs = rows
        for _, function in corpus_pipeline.STAGES:
            docs = stage(function(spark, docs, SF), "t")
        assert docs.count() >= 0 and "ids" in docs.columns


def test_long_text_is_whole():
    assert simhash.fingerprint(LONG) == plain_fingerprint(LONG)
