"""Collocations, token alignment and line dedup against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from fixtures import LONG, LOWER, empty, messy, messy_rows
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from contractspark.llm import alignment, collocations, line_dedup
from contractspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
A_FILE, B_FILE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()


# ---- collocations ------------------------------------------------------------------------------------------
def plain_counts(rows):
    """lang -> phrase (tuple) -> count, for 1 to 5 words."""
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, 6):
                counts["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return counts


def plain_collocations(rows, least, top):
    found = []
    for lang, f in plain_counts(rows).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        frequent = {p: v for p, v in f.items() if v >= least}
        scored = []
        for p, a in frequent.items():
            inside = (q for q in frequent if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if len(p) > 1 and not any(100 * frequent[q] >= 100 * a for q in inside):
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(found)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("parts, least, top", [(1, 4, 2000), (7, 3, 50)])
def test_collocations_equal_brute_force(spark, documents, parts, least, top):
    some = [(r.lang, r.text) for r in documents[:60]] + [(None, "a b\ta b. A B c;c b a b"), ("x", None), ("x", ""), ("", "é É é é. É é"), ("x", "q " * 40)] * 2
    frame = spark.createDataFrame(some, "lang string, text string").repartition(parts)
    got = as_rows(collocations.collocations(frame, least, top=top))
    assert got == plain_collocations(some, least, top) and len(got) > 50


def test_op11_equals_brute_force_on_a_table(spark, documents):
    assert as_rows(QUERIES["op11_collocations"](spark, SF)) == plain_collocations([(r.lang, r.text) for r in documents], 100, 2000)


def test_collocations_of_awkward_rows(spark):
    rows = [(r.lang, r.text) for r in messy(spark).select("lang", "text").collect()]
    assert as_rows(collocations.collocations(messy(spark), 2)) == plain_collocations(rows, 2, 2000)
    assert collocations.collocations(empty(spark), 2).count() == 0
    assert collocations.collocations(spark.createDataFrame([("de", " .\n,")], "lang string, text string"), 1).count() == 0


def test_index_enumerates_every_phrase():
    """Counts, extensions and pruning of one shard's index against plain counting."""
    rng = random.Random(2)
    text = "".join(rng.choice("ab c d e .\t") for _ in range(4000)) + " end"
    ids, words = collocations.word_sequence(text.encode())
    hashes = collocations.word_hashes(words, "x")
    plain, known = plain_counts([("x", text)])["x"], words.to_pylist()
    column = collocations.bwt(ids, 5)
    texts, every, seen = None, lambda k, h: np.ones(h.shape[1], bool), {}
    for k, counts, first, tails, h in collocations.phrases(column, hashes, every, 5):
        texts = [known[f] + (" " + texts[t] if k > 1 else "") for f, t in zip(first, tails)]
        seen |= dict(zip(texts, counts.tolist()))
        assert len(set(h[0].tolist())) == len(set(h[1].tolist())) == len(counts)
    assert seen == {" ".join(p): n for p, n in plain.items()}
    often = {p for p, n in plain.items() if n >= 5}
    sizes = {}
    for k, counts, *_ in collocations.phrases(column, hashes, lambda k, h: every(k, h) if k > 1 else np.array([plain[(w,)] >= 5 for w in known]), 3):
        sizes[k] = len(counts)
    assert sizes[1] == sum(len(p) == 1 for p in often)
    assert sizes[2] == sum(len(p) == 2 and all((w,) in often for w in p) for p in plain)


def test_bit_map_has_no_false_negatives(spark):
    keys = np.array([random.Random(i).getrandbits(64) for i in range(3000)], np.uint64)
    bits = collocations.bit_map(spark.createDataFrame([(k,) for k in keys.view(np.int64).tolist()], "h long"))
    assert collocations.may_hold(bits, keys).all() and not collocations.may_hold(bits, keys + np.uint64(1)).any()


def test_long_texts_are_cut_at_lines():
    text = b"\n".join(b"w%d" % i for i in range(500))
    for size in (1, 10, 100, 10_000):
        parts = list(collocations._cut(text, size))
        assert b"\n".join(parts) == text


# ---- alignment ---------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B_FILE)
    return a, b


def plain_alignment(texts, libraries):
    """Rows in the order of the texts, from the libraries' tokens of the whole texts."""
    a, b = libraries
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in letters} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in letters)}
    linked, sizes = [], []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            linked.append(collections.Counter())
            sizes.append((0, 0, 0, 0, ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
        both = np.intersect1d(ends_a, ends_b)
        groups_a, groups_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        left, right = [[] for _ in both], [[] for _ in both]
        for i, g in zip(ids_a, groups_a):
            left[g].append(i)
        for i, g in zip(ids_b, groups_b):
            right[g].append(i)
        links = collections.Counter((x, y) for p, q in zip(left, right) for x in p for y in q)
        listed = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in zip(left, right))
        linked.append(links)
        sizes.append((len(ids_a), len(ids_b), len(both), sum(links.values()), hashlib.sha256(listed.encode()).hexdigest()))
    counts = collections.Counter(p for links in linked for p in links)
    best = collections.Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [
        (*s[:4], sum(m for p, m in links.items() if counts[p] == best[p[0]]), sum(m * counts[p] for p, m in links.items()), s[4])
        for s, links in zip(sizes, linked)
    ]


def aligned(df, spark, parts=None):
    rows = alignment.align(df.repartition(parts) if parts else df, A_FILE, B_FILE)
    return rows.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()


@pytest.mark.parametrize("parts", [1, 13])
def test_alignment_of_strange_texts(spark, libraries, parts):
    rng = random.Random(4)
    marks = [" ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "a", "word", "'s", "1234", "é", ",", "日本", "▁", "<s>", "<0x0A>", "\U0001F600", "ﬁ", "<|endoftext|>"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(1500)] + ["", " ", "aa " * 500, "x" * 3000, "日本" * 900 + "語é" * 300, "\n" * 3000 + " " * 3000, "aé" * 9000, " lead", "trail ", LONG[:20_000]]
    got = aligned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark, parts)
    assert [tuple(r)[1:] for r in sorted(got)] == plain_alignment(texts, libraries)


def test_op12_on_a_table(spark, documents, libraries):
    got = QUERIES["op12_token_alignment"](spark, SF).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    want = plain_alignment([r.text for r in documents], libraries)
    assert sorted(map(tuple, got)) == sorted((r.doc_id, *w) for r, w in zip(documents, want))


def test_alignment_of_awkward_rows(spark, libraries):
    rows = [(r.doc_id, r.text) for r in messy(spark).select("doc_id", "text").collect()]
    want = plain_alignment([t or "" for _, t in rows], libraries)
    key = lambda t: (t[0] is not None, *map(str, t))
    assert sorted((tuple(r) for r in aligned(messy(spark), spark)), key=key) == sorted(((d, *w) for (d, _), w in zip(rows, want)), key=key)
    assert aligned(empty(spark), spark) == []


def test_packed_columns_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        a, b = np.sort(rng.integers(0, 1 << 40, n)), rng.integers(0, 1 << 50, n)
        back = alignment._unpack(alignment._pack(a, b))
        assert np.array_equal(back[0], a) and (n == 0 or np.array_equal(back[1], b))
    (held,) = alignment._unpack(alignment._pack(np.array([5, 1, 7])))
    assert held.tolist() == [5, 1, 7]


def test_known_parts_are_bounded(libraries):
    aligner = alignment.Aligner(open(A_FILE, "rb").read(), open(B_FILE, "rb").read())
    for i in range(0, 40_000, 500):
        aligner.align([" ".join(f"{j:x}" * 20 for j in range(i, i + 500))])
        aligner.align(["".join(chr(0x4E00 + (i + j) % 9000) for j in range(2000))])
    assert aligner.letters <= alignment.MEMO_LETTERS + 500 * 120 + 2001 and all(len(p) <= alignment.LONG_PART for p in aligner.known)


# ---- line dedup --------------------------------------------------------------------------------------------
BLANK = " \t\n\x0b\x0c\r"


def plain_lines(rows, least=3, min_chars=20):
    """(id, n_lines, n_dropped, text) of rows; ids may repeat."""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    holders = collections.defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    order = lambda d: (d is not None, d)
    keeper = {k: max(ids, key=order) for k, ids in holders.items() if len(ids) >= least}
    made = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), d) == d]
        made.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(made, key=lambda r: (order(r[0]), *r[1:]))


def dropped(docs, index, **options):
    rows = line_dedup.drop_repeated_lines(docs, index, **options).select("doc_id", "n_lines", "n_dropped", "text").collect()
    return sorted(map(tuple, rows), key=lambda r: ((r[0] is not None, r[0]), *r[1:]))


def test_op13_on_a_table(spark, documents):
    got = sorted(map(tuple, QUERIES["op13_line_dedup"](spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()))
    want = [(d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in plain_lines([(r.doc_id, r.text) for r in documents])]
    assert got == want and sum(r[2] for r in got) > 20


def batch(seed, ids):
    rng = random.Random(seed)
    line = lambda: rng.choice([f"Line number {rng.randrange(12)} that repeats", "short", "", f"\t LINE NUMBER {rng.randrange(4)} that repeats \r", "é" * rng.randrange(17, 23), f"own {rng.random()} " * 2])
    return [(i, "\n".join(line() for _ in range(rng.randrange(1, 9)))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def state(index):
    return sorted(map(repr, index.refs.collect())), sorted(map(repr, index.counts.collect()))


def test_documents_go_in_and_out(spark):
    first, second, third = batch(1, range(40)), batch(2, range(35, 70)), [(None, "Line number 3 that repeats")] + batch(3, [80, 80, 81])
    second = [r for r in second if r[0] >= 40]
    empty_index = line_dedup.LineIndex.empty(spark, 100)
    one = empty_index.insert(frame(spark, first))
    two = one.insert(frame(spark, second)).insert(frame(spark, third))
    every = first + second + third
    assert dropped(frame(spark, every), two) == plain_lines(every)
    assert state(two) == state(two.insert(frame(spark, second)))
    back = two.delete(frame(spark, second + third))
    assert state(back) == state(one) and dropped(frame(spark, first), back) == plain_lines(first)
    some = [r for r in every if r[0] is None or r[0] % 3]
    assert dropped(frame(spark, some), two.delete(frame(spark, [r for r in every if r not in some]))) == plain_lines(some)
    none = back.delete(frame(spark, first))
    assert state(none) == state(empty_index)
    assert all(not any(any(link) for link in line_dedup.CuckooFilter.load(r.filter).links) for r in none.filters.collect())


def test_filters_never_miss_and_shrink():
    rng = random.Random(9)
    keys = [rng.getrandbits(64) for _ in range(3000)] + [5 << 48 | 7] * 30
    own = line_dedup.CuckooFilter(buckets=128)
    for k in keys:
        own.add(k)
    assert len(own.links) > 1 and all(k in own for k in keys)
    own = line_dedup.CuckooFilter.load(own.dump())
    for k in keys[:1500]:
        own.remove(k)
    assert all(k in own for k in keys[1500:])
    assert sum(rng.getrandbits(64) in own for _ in range(2000)) < 100
    for k in keys[1500:]:
        own.remove(k)
    assert not any(any(link) for link in own.links)
    with pytest.raises(KeyError):
        own.remove(1)


def test_lines_of_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in messy(spark).collect()]
    index = line_dedup.LineIndex.empty(spark, 10, min_chars=2).insert(messy(spark))
    assert dropped(messy(spark), index, least=2) == plain_lines(rows, 2, 2)
    kept = line_dedup.drop_repeated_lines(messy(spark), index)
    assert set(messy(spark).columns) <= set(kept.columns)
    bare = line_dedup.LineIndex.empty(spark, 0)
    assert line_dedup.drop_repeated_lines(empty(spark), bare.insert(empty(spark))).count() == 0
    assert len(dropped(messy(spark), bare)) == len(messy_rows())


def test_new_operators_run_without_collecting_rows(spark):
    """Hot lines and words: one line in every document stays in one, and counts are whole."""
    rows = [(i, "This very line is in every document.\nown %d line of some length" % i) for i in range(500)]
    index = line_dedup.LineIndex.empty(spark, 1000).insert(frame(spark, rows).repartition(9))
    assert dropped(frame(spark, rows), index) == plain_lines(rows)
