"""Case tables for the column functions; Python's own parsers serve as a second opinion."""

import json
import random
import re
import timeit

import pytest
from pyspark.sql import functions as F

from contractspark.functions import dates, flags, grounding, jsonx, messages, outputs, parties, repetition, scoring, text, tokens
from contractspark.functions.repetition import loop_start
from contractspark.rules import FIELDS, LOOP_MAX_LEN, LOOP_MIN_LEN


def column(spark, values, fn, schema="string"):
    """[fn(value) for each value], in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r[0] for r in df.withColumn("o", fn(F.col("v"))).orderBy("i").select("o").collect()]


def label_column(spark, contents, fn):
    return column(spark, contents, lambda v: fn(jsonx.strict_label(v)))


def test_strip_and_words_follow_python(spark):
    values = ["", "  a\t b\x0b", " x ", "\x1c\x85y z　", "a\nb  c"]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.words) == [v.split() for v in values]


@pytest.mark.parametrize("chars", [" ", " \t"])
def test_strip_inside_array_functions_keeps_digits(spark, chars):
    got = column(spark, ["10,20 , 30"], lambda v: F.transform(F.split(v, ","), lambda p: text.strip(p)))
    assert got == [["10", "20", "30"]]


def test_normalize_text(spark):
    cases = {"Acme, Inc.": "acme inc", "  AÉ_b\n\t9 ": "aé_b 9", "--": "", "": "", None: "", "éx": "ex"}
    assert column(spark, list(cases), text.normalize_text) == list(cases.values())


def test_normalize_date(spark):
    cases = {
        "March 5, 2024": "2024-03-05", "mar 5, 2024": "2024-03-05", "March 5 2024": "2024-03-05", "SEP 30 1999": "1999-09-30",
        "2024-1-5": "2024-01-05", "2024-01-05": "2024-01-05", "1/2/2024": "2024-01-02", "13/02/2024": "2024-02-13", "13/13/2024": None,
        "5 March 2024": "2024-03-05", "05 Sep 2024": "2024-09-05", "March  5,\n2024": "2024-03-05", "Feb 30, 2024": None,
        "March 5, 2024 or so": None, "Sept 5, 2024": None, "May 7, 1999": "1999-05-07", "2024-02-30": None, "24-01-05": None,
        "  2020-02-29 ": "2020-02-29", "March 5,2024": None, "2023-02-29": None, "Not Specified": None, "": None,
    }
    got = [d and d.isoformat() for d in column(spark, list(cases), dates.parse_date)]
    assert dict(zip(cases, got)) == cases
    assert column(spark, ["Upon notice!", None, " "], dates.normalize_date) == ["upon notice", "", ""]


def test_strict_label_accepts_what_json_accepts(spark):
    values = [
        '{"liability_cap": "x"}', ' {"liability_cap": "x"}\n', '{"liability_cap": "x"} tail', '{"liability_cap": "x"',
        "{'liability_cap': 'x'}", '{"liability_cap": "a\nb"}', '{"liability_cap": "x", "liability_cap": "y"}', "{}", "", "null",
        '{"a": [1, {"b": 2}], "liability_cap": "x"}', '{"liability_cap": "x"}{"b": 1}', '{"liability_cap": "x",}', "text", '"{}"',
    ]

    def expected(value):
        try:
            parsed = json.loads(value)
        except ValueError:
            return None
        return parsed.get("liability_cap", "") if isinstance(parsed, dict) else None

    got = label_column(spark, values, lambda l: F.when(l.isNotNull(), jsonx.stringify(l["liability_cap"])))
    # accepted by Spark's reader although not strict JSON: single quotes are off, raw newlines are not
    assert [g for i, g in enumerate(got) if i != 5] == [expected(v) for i, v in enumerate(values) if i != 5]


def test_strict_label_rejects_what_follows_the_object(spark):
    """Also text that closes an enclosing array or goes on with more entries."""
    good = '{"liability_cap": "x"}'
    tails = ["]", "] and more", ",", ", " + good, "," + good + "]", " x", "}", ",null", "null"]
    values = [good, f" \n\t{good}\r\n", *[good + t for t in tails], "[" + good + "]", "null", "\u00a0" + good]
    assert label_column(spark, values, lambda l: l.isNotNull()) == [True, True] + [False] * (len(values) - 2)


def test_words_follow_python_for_every_blank(spark):
    values = [" a\u2003b\x1cc\x85d\xa0e  f\n", "\u3000", "", "x"]
    assert column(spark, values, text.words) == [v.split() for v in values]


def test_stringify_matches_python_str(spark):
    values = [["a", "b"], [], ["it's"], ['q"t'], ["x\ny", "b\\s"], "plain", None, True, [None, False, "z"], ["Not Specified"]]
    contents = [json.dumps({"parties": v}) for v in values] + ["{}"]
    want = [str(v) for v in values] + [""]
    assert label_column(spark, contents, lambda l: jsonx.stringify(l["parties"])) == want


def test_first_object(spark):
    values = ['say {"liability_cap": "x"} and {"liability_cap": "y"}', '```json\n{"liability_cap": "x"}\n```', "none", '{"liability_cap": "x", "b', ""]
    got = column(spark, values, lambda v: jsonx.as_text(jsonx.first_object(v)["liability_cap"]))
    assert got == ["x", "x", None, None, None]


def test_close_truncated(spark):
    cases = {
        '{"a": "1", "b": "2': '{"a": "1"}', '{"a": "1': "{}", '{"a": "x, y': '{"a": "x"}', "no braces": None,
        '{"a": {"b': '{"a": {}', '{"a": ["x", "y': '{"a": ["x"}', '{"a": "1", , \n': '{"a": "1"}', "": None,
    }
    assert column(spark, list(cases), jsonx.close_truncated) == list(cases.values())


def test_unfence(spark):
    cases = {"```json\n{}\n```": "{}\n", " `x` ": "x", "json\n\n{}": "{}", "jsonish": "ish", "{}": "{}"}
    assert column(spark, list(cases), outputs.unfence) == list(cases.values())


def test_loop_start_finds_the_loop_that_was_placed():
    """A unit without inner repetition, repeated between texts of other letters; ``found`` is the least chunk
    length that is a multiple of both the unit and five."""
    chance = random.Random(7)
    for unit_length, found in ((5, 25), (7, 35), (14, 70), (25, 25), (28, 140), (30, 30), (33, 165), (40, 40), (200, 200)):
        for _ in range(12):
            head = "".join(chance.choices("ABCDEFGHIJ", k=chance.randint(0, 20)))
            unit = "x" + "".join(chance.choices("abcdefgh \n", k=unit_length - 2)) + "y"
            enough = -(-3 * found // unit_length)
            assert loop_start(head + unit * (enough + chance.randint(0, 2)) + "0123") == len(head)
            assert loop_start(head + unit * (enough - 1) + "0123456789") == -1
            assert loop_start(" " * 300 + head + unit * enough + "0123") == 300 + len(head)


def test_loop_search_costs_little_more_than_finding_its_lengths():
    looped = '{"termination_conditions": "ends upon breach of a term' + " the buyer may end the deal " * 30

    def best(run):
        return min(timeit.repeat(run, number=20, repeat=15))

    lengths = best(lambda: repetition._possible_lengths(looped, LOOP_MIN_LEN, LOOP_MAX_LEN))
    assert best(lambda: loop_start(looped)) < 2.2 * lengths


def test_equal_texts_agree_without_being_taken_apart(spark):
    pairs = spark.createDataFrame([("A and B", "A and B"), ("", ""), (None, None), ("1/2/2020", "2020-1-2"), ("b, A", "a and B"), (None, "x")], "p string, t string")
    scores = [scoring.date_match(F.col("p"), F.col("t")), scoring.token_f1(F.col("p"), F.col("t")), scoring.party_f1(F.col("p"), F.col("t"))]
    got = pairs.select(*[s.alias(str(i)) for i, s in enumerate(scores)]).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (1, 0, 0), (0, pytest.approx(0.8), 1), (0, 0, 0)]
    plans = [pairs.select(s)._jdf.queryExecution().analyzed().toString() for s in scores]
    assert all(re.search(r"CASE WHEN \(p#\d+ = t#\d+\) THEN", p) for p in plans)


def test_loop_must_end_before_the_text_does():
    unit = "abcdefghijklmnopqrstuvwxy"  # 25 characters
    assert loop_start("{" + unit * 3) == -1
    assert loop_start(unit * 3) == -1 and loop_start(unit * 3 + "z") == 0
    assert loop_start(" " * 400) == -1


def test_clean_entries(spark):
    cases = [
        (None, "", "dropped"), ("  ", "", "dropped"), ("TENANT: Acme LLC", "Acme LLC", ""), ("TENANT:", "", ""),
        ("We shall do it", "", "dropped"), ("ABCDEFGHIJKLMN shall", "ABCDEFGHIJKLMN shall", ""),
        ("ABCDEFGHIJKLM shall", "", "dropped"), ("Acme (hereinafter Buyer)", "Acme", "truncated"),
        ("X, a company", "", "dropped"), ("XY, a company", "XY", "truncated"), ("Acme,, whose address is", "Acme", "truncated"),
        ("Buyer : seller: Z Corp", "seller: Z Corp", ""), ("Jo with his principal place of business", "Jo", "truncated"),
        ("abcdefghijklmnop one two three four five six seven eight nine shall ten", "abcdefghijklmnop one two three four five six seven eight nine shall ten", ""),
        ("abcdefghijklmnop one two three four five six seven eight nine ten shall x", "", "dropped"),
        (" " + "word " * 20, ("word " * 20).strip(), ""),
    ]
    df = spark.createDataFrame([([c[0] for c in cases],)], "v array<string>")
    got = df.select(parties.clean_entries(F.col("v"))).first()[0]
    assert [(g["cleaned"], g["reason"]) for g in got] == [c[1:] for c in cases]


def test_clean_parties_by_type(spark):
    contents = [json.dumps({"parties": v}) for v in (["A LLC", 5, "X shall pay"], "A LLC; We shall pay, B", {"a": 1}, None)] + ["{}"]
    got = label_column(spark, contents, lambda l: parties.clean_parties(l["parties"]))
    assert [g and [(i["original"], i["cleaned"], i["reason"]) for i in g] for g in got] == [
        [("A LLC", "A LLC", ""), ("5", "", "dropped"), ("X shall pay", "", "dropped")],
        [("A LLC", "A LLC", ""), ("We shall pay", "", "dropped"), ("B", "B", "")],
        None, None, None,
    ]


def test_scores(spark):
    cases = [
        ("liability_cap", "", "", 1.0), ("liability_cap", "x", "", 0.0), ("liability_cap", "a b", "c d", 0.0),
        ("liability_cap", "a b", "b c d", 0.4), ("liability_cap", "USD 5!", "usd 5", 1.0),
        ("parties", "['A LLC', 'B']", "A LLC and B", 1.0), ("parties", "A; b, C", "a", 0.5), ("parties", "Anderson", "Anders", 0.0),
        ("effective_date", "March 5, 2024", "2024-03-05", 1.0), ("effective_date", "", " ", 1.0), ("effective_date", "x", "y", 0.0),
    ]
    for field, pred, truth, want in cases:
        df = spark.createDataFrame([(pred, truth)], "p string, t string")
        assert df.select(scoring.score_field(field, F.col("p"), F.col("t"))).first()[0] == pytest.approx(want), (field, pred)


def test_grounding_threshold_and_nulls(spark):
    source = F.lit("one two three and more")
    values = ["one two three four", "one two x y", "N/A", "None", None, "", "ONE TWO", "wo thre"]
    assert column(spark, values, lambda v: grounding.is_grounded(v, source)) == [True, False, True, True, True, True, True, True]
    wrong = lambda v: grounding.is_hallucinated(v, text.normalize_text(v), source)
    assert column(spark, ["none", "['Not Specified']", "Not Specified", "!!", "one two three four", ""], wrong) == [
        True, True, False, False, False, False,
    ]


def test_flags_and_document_type(spark):
    assert column(spark, ["See SEC filing", "insec", "Form 10-K", "plain"], flags.document_type) == [
        "real_world_sec_style", "templated_synthetic", "real_world_sec_style", "templated_synthetic"]
    contents = [json.dumps({"effective_date": v}) for v in ("Upon NOTICE", "2024-01-01", 5, None)] + ["{}"]
    got = label_column(spark, contents, lambda l: flags.date_is_suspicious(l["effective_date"]))
    assert got == [True, False, False, False, False]


def test_messages_roles_and_rendering(spark):
    rows = [([("system", "s"), ("user", "u"), ("assistant", "a"), ("assistant", "b")],), ([("user", "u")],), ([],)]
    df = spark.createDataFrame(rows, "m array<struct<role:string,content:string>>")
    m = F.col("m")
    got = df.select(messages.first_of_role(m, "assistant"), messages.role_index(m, "assistant"), F.size(messages.without_role(m, "assistant"))).collect()
    assert [tuple(r) for r in got] == [("a", 2, 2), (None, -1, 1), (None, -1, 0)]
    prompt = df.select(messages.render_chat(messages.without_role(m, "assistant"), add_reply_header=True)).first()[0]
    assert prompt.endswith("u<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n")


def test_token_count(spark):
    assert column(spark, ["Hello, wörld_1!", "", None, " \n"], tokens.regex_token_count) == [4, 0, 0, 0]


def test_a_label_ends_with_its_brace(spark):
    texts = ['{"parties": []}', '{"parties": []} \n\t\r', '{"parties": []},null]', '{"parties": []}\u00a0', '{"parties": [] ', '{"parties": []} words', " {}", None, ""]
    assert column(spark, texts, lambda t: jsonx.strict_label(t).isNotNull()) == [True, True, False, False, False, False, True, False, False]


ODD_NAMES = [
    None, "", " ", ",", "Acme, Beta; Gamma and Delta", "Sandy ANDroid aNd Brandy", "a_and_b and\u00a0c", "x and\u0301 y", "\u0391\u03a3.and \u0391\u03a3, \u03a3\u0391\u03a3;b",
    "\u0130 and I", "\ta\x1f ,\u2003 b\u3000 ,, c and", "and", "And and AND", "1and 1 and2", "p\U0001f600and q", "a - b , - , c", "['A & B', \"C\"]", "A\n and\r\nB",
]


def test_party_names_are_those_of_each_part_on_its_own(spark):
    def parts(value):
        commas = F.replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?iU)\band\b", ","), F.lit(";"), F.lit(","))
        return F.array_distinct(F.array_remove(F.transform(F.split(commas, ","), lambda p: text.normalize_text(p)), ""))

    assert column(spark, ODD_NAMES, scoring.split_parties) == column(spark, ODD_NAMES, parts)


def test_patterns_for_speed_hold_the_same_characters(spark):
    codes = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")
    )
    bare, plain = F.regexp_replace("c", text.NOT_WORD_OR_SPACE, ""), F.regexp_replace("c", text.NOT_WORD_OR_SPACE_RUN, "")
    spaces = F.regexp_replace("c", text.SPACE_RUN, " ") != F.regexp_replace("c", text.UNEVEN_SPACE_RUN, " ")
    assert codes.where((bare != plain) | spaces).count() == 0
    runs = [a + b + c for a in ("", "x", " ", "\t") for b in (" ", "  ", "\t ", " \u2003", "\n\n", " y ") for c in ("", "z", " ")]
    assert column(spark, runs, text.collapse_spaces) == column(spark, runs, lambda v: F.trim(F.regexp_replace(v, text.SPACE_RUN, " ")))


def test_staged_columns_equal_the_column_functions(spark):
    bodies = [
        None, "", " ", "\u3000{}\u00a0", "```json\n{\"parties\": [\"a\", \"it's\"]}\n```", '{"parties": ["a", null, "b\\n"]}', '{"parties": []}', '{"parties": ["x", 1]}',
        '{"parties": ["a\\"b", "c"], "liability_cap": ["p", "q"], "effective_date": "2024-1-2 "}', '{"parties": "a", "liability_cap": 1.5, "effective_date": null}',
        "json{}", "`{}", '{"a": {"b": 1}, "c": "d', '{"parties": ["a"]},null]', "no, {", ",", "a\n,b\n{c\n", "\u00e9, x",
    ]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, v string")
    staged = outputs.with_unfenced(rows, "v", "t")
    staged = jsonx.with_closed(jsonx.with_strict_label(staged, "t", "label"), "t", "closed")
    label = F.col("label")
    wrong = jsonx.with_field_texts(staged, "label", "p_").where(
        ~F.col("t").eqNullSafe(outputs.unfence(F.col("v"))) | ~F.col("closed").eqNullSafe(jsonx.close_truncated(F.col("t")))
        | (label.isNull() != jsonx.strict_label(F.col("t")).isNull())
        | ~F.array(*[F.col(f"p_{f}") for f in FIELDS]).eqNullSafe(F.array(*[jsonx.stringify(label[f]) for f in FIELDS]))
    )
    assert wrong.select("v").collect() == []
    values = spark.createDataFrame([(v,) for v in [*ODD_NAMES, "N/A", " n/a\t", "Not Specified", "not. specified", "na", "-"]], "v string")
    told, normal = grounding.is_populated(F.col("v")), text.normalize_text(F.col("v"))
    assert values.where(~told.eqNullSafe(grounding.normal_is_populated(F.col("v"), normal))).count() == 0


def test_first_of_role_looks_behind_the_first_messages(spark):
    kind = "array<struct<role:string,content:string>>"
    cases = [None, [], [("a", "1")], [(None, "x"), ("b", None), ("b", "2")], [("a", "")] * 3 + [("b", "4"), ("b", "5")]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, m {kind}").orderBy("i")
    assert [r[0] for r in df.select(messages.first_of_role(F.col("m"), "b")).collect()] == [None, None, None, None, "4"]
