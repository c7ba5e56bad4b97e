"""Tokens, mixing and residue against the tokenizer, exact sums and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("rxloom.llm.queries")
from rxloom.llm import mixing, residue, tokens  # noqa: E402

TEXTS = [
    None, "", " ", "\n\n", "a", "Hello world", "it's they'll I'M we've", "  two  spaces\t\ttab ", "naïve café — “q”", "日本語のテキスト 123", "🙂🙂 👩‍👩‍👧 end", "x" * 5000, "<|endoftext|> as text", "12345 67.8%", "a b c\u0085d", "ȩ́ ​﻿ z",
    "الدواء препарат", "\x1c\x1d mix \x0b", "can't'd's", "ﬁ Ⅷ ½ ² ٣", "\U00010400\U0001d7d8 ᠎|", "word " * 40_000, "Hello world",
]


def test_encoding_equals_the_tokenizer_and_comes_back(spark):
    r = random.Random(0)
    mixed = ["".join(r.choice("ab '\n\t1é—🙂  .sSdt") for _ in range(r.randrange(60))) for _ in range(300)]
    rows = list(enumerate(TEXTS + mixed))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(0, None, "y"), (None, "lost", "z")], "doc_id long, text string, ids string")
    own = tokens._tokenizer(tokens.TOKENIZER)
    want = {i: own.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    for frequent in (tokens.FREQUENT, 8):  # also with most words on the shuffled way
        encoded = tokens.encode(spark, df, frequent=frequent)
        assert {x.doc_id: list(x.ids) for x in encoded.collect()} == want
    assert {x.doc_id: x.tokens for x in tokens.count_tokens(spark, df).collect()} == {i: len(v) for i, v in want.items()}
    assert {x.doc_id: x.text for x in tokens.decode(spark, encoded).collect()} == {i: t or "" for i, t in rows}


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode(spark, empty).count() == 0 and tokens.count_tokens(spark, empty).count() == 0


TARGETS = [("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.2, 4), (None, 0.0, 1)]


def test_mixing(spark):
    r = random.Random(1)
    docs = [(i, " ".join("word" for _ in range(r.randrange(1, 60))), "big") for i in range(900)] + [(1000 + i, "word " * r.randrange(1, 80) + "end", "small") for i in range(150)]
    docs += [(2000 + i, "same text here", "tiny") for i in range(200)] + [(3000, None, "big"), (3001, "", "tiny"), (3002, "left out", "other"), (3003, "left out", None)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mixing.mix(spark, df, targets)
    got = mixed.collect()
    assert len(got) == 900 + 150 + 200 + 2
    caps = {s: c for s, _, c in TARGETS}
    assert all(0 <= x.copies <= caps[x.source] for x in got) and all(x.copies == 0 for x in got if x.tokens == 0)
    longest, total = max(x.tokens for x in got), sum(x.tokens * x.copies for x in got)
    table = {x.source: x for x in mixing.shares(mixed, targets).collect()}
    assert all(abs(table[s].actual_share - share) * total <= 2 * longest for s, share, _ in TARGETS[:3])
    assert any(x.most_repeats == caps[s] for s, x in table.items())
    again = {x.doc_id: x.copies for x in mixing.mix(spark, df.repartition(5), targets).collect()}
    assert again == {x.doc_id: x.copies for x in got}


def test_a_total_beyond_what_sources_have(spark):
    df = spark.createDataFrame([(i, "one two three", "big" if i % 2 else "small") for i in range(20)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = {x.source: (x.copies, x.actual_share) for x in mixing.shares(mixing.mix(spark, df, targets, total=1e6), targets).collect()}
    assert got == {"big": (10, 1 / 3), "small": (20, 2 / 3), "none": (0, 0.0)}
    assert mixing.mix(spark, df.limit(0), targets).count() == 0 and mixing.mix(spark, df, targets).agg(F.sum("copies")).first()[0] == 0  # a source with a share has nothing


PLACEHOLDERS = "{{name}}|{{ lot }}|${dose}|#{dose}|{manufacturer}|%DOSE%|{% if route %}|<%= ndc %>|[[route]]|[insert dose]|[TBD:x]|[PATIENT_NAME_2]|<brand_name>|<<dose>>|&lt;route&gt;|«dose»|__NDC__|@@ndc@@|$DOSE$|%(dose)s|_________|XXXX".split("|")
FINE = [
    None, "", " \n", "Take <5 mg and p<0.05 > n=299, 5% to 10%.", "The set {drug, form, strength} identifies a label.", "See [Figure 3], [see Warnings (4.1)], [1, 3] and [14C].", "<p>Take one <b>tablet</b> by mouth.</p>",
    "Access was denied to 57 applicants of the trial because of asthma.", "The server of the blood bank timed out once in 40 hours, yet no result was lost.", "Not found in this study: cough, or any bleeding.", "A pump display of error 404 or 503 means air in the line; call the clinic.",
    "Our label viewer needs no JavaScript and no cookies; it prints the leaflet as plain text.", "Two new scripts are required for each refill.", "The page was found missing from the binder, so the nurse wrote the dose by hand.", "Samples of placeholder gel (placebo) were given to infants.",
    "Home | Labels | Recalls | Contact\n\nAccess was denied to 74 applicants of the trial.\n© Label Archive", "patients with an XX karyotype", "very " * 3 + "good", "```\nprint(f'{name}')\n``` shows a value.", "Store at 20 °C. " * 20_000, "el texto dice «no lo use si está embarazada» y más",
]
BAD = [
    "Take [insert dose here] daily.", "Use XXXX (dose to be filled in) daily.", "Give (enter patient.name) one.", "Text before. Lorem ipsum dolor sit amet consectetur adipiscing elit. Text after.", "xxx xxx xxx xxx xxx xxx", "foo bar foo bar foo bar foo bar", "Texte de remplacement, à compléter.",
    "Blindtext, bitte ersetzen.", "Aquí va el texto definitivo.", "Testing testing one two three.", "HTTP Status 404 - Not Found\ntype Status report", "410 Gone\n\nThe label you asked for could not be located on this server.", "Menu  Search  Log in\n\nAccess denied. You do not have permission.\n© Label Archive",
    "Please enable JavaScript to view this label.", "<noscript>Content cannot be displayed unless scripting is active.</noscript>", "Traceback (most recent call last):\n  File \"x.py\", line 1\nKeyError: 'w'", '{"error": {"code": "GONE", "message": "No matches found!"}}', "Verify that you are human by ticking the box.",
    "Fehler 400: Die angeforderte Seite wurde nicht gefunden.", "Page introuvable.", "Service temporarily down for maintenance.", "THIS SITE NEEDS SCRIPTS AND COOKIES TO SHOW DRUG INFORMATION.", "A long text. " * 30_000 + "{{name}}",
]


def test_residue(spark):
    whole = FINE + BAD + [f"Take {p} daily with food." for p in PLACEHOLDERS]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(whole)], "doc_id long, text string, filler boolean")
    got = {r.doc_id for r in residue.find_residue(df).collect()}
    assert [whole[i] for i in range(len(FINE)) if i in got] == []
    assert [whole[i][:80] for i in range(len(FINE), len(whole)) if i not in got] == []
    assert residue.find_residue(df.limit(0)).count() == 0


TRACE = "java.lang.IllegalStateException: no label\n" + "".join(f"\tat org.labels.Viewer.step{i}(Viewer.java:{i})\n" for i in range(300))
PY_TRACE = "Traceback (most recent call last):\n" + "".join(f'  File "/srv/labels/view{i}.py", line {i}, in show\n    return render(label, {i})\n' for i in range(200)) + "KeyError: 'dose'"
LONG_PAGES = [
    TRACE, PY_TRACE, "404 Not Found\n\n" + "The requested page was not found on this server. Please go back and try again.\n" * 60, "Home | " + "Labels | " * 60 + "Recalls\n" + "Home | Labels\n" * 400 + "Access denied. You do not have permission.",
    '{"error": {"code": "GONE", "trace": "' + "frame " * 900 + '"}}', "<noscript>" + "Content cannot be displayed unless scripting is active. " * 80 + "</noscript>", "Service temporarily unavailable." + "\n \n" * 3_000,
]
LONG_PROSE = [
    "Exceptions to this dose are listed below. " + "Take one tablet with food in the morning. " * 90, "Error 404 means air in the line. " + "Call the clinic if the pump stops. " * 200,
    "The log of the pump is kept.\n" * 50 + TRACE[:200] + "\n" + "Store the pump at room temperature.\n" * 50, "El envase se guarda en su caja. " * 100,
]


def test_error_pages_of_any_length(spark):
    df = spark.createDataFrame(list(enumerate(LONG_PAGES + LONG_PROSE)), "doc_id long, text string")
    assert {r.doc_id for r in residue.find_residue(df).where("error_page").collect()} == set(range(len(LONG_PAGES)))


EXPLAINED = [
    "Use ${HOME} in your shell script.", "This is a tutorial on letters.\nWrite {{name}} in the first line.\nWrite {{dose}} in the second.", "How to use merge fields. Put {{name}} first.",
    "In a letter {{name}} stands for the patient's name.", "The placeholder ${dose} is replaced by the dose when the label is printed.", "Put `{{name}}` at the head of the letter.", "A variable is written like {{name}} in this system.",
    "```\n" + "value = '{{name}}'\n" * 3_000 + "```\nshows a value.", "Example:\n```\nHello {{name}}\n", "<pre>" + "${dose} " * 5_000 + "</pre> ends.", "See <code>{{name}}", "Put `{{a}}` first.\nPut `{{b}}` next.\nPut `{{c}}` last.\nThe letter then begins with {{a}}.",
]
UNFILLED = [
    "```\ncode\n```\nDear {{name}}, take one.", "Put `{{name}}` at the head.\nDear {{name}}, take one.", "Take ${dose} of this placeholder daily.", "Use a ``` mark.\nTake {{dose}} daily.", "See <code>x\nTake {{dose}} daily.", "[placeholder for dose_unit] take [dose_unit] like this: {{dose}}.\nTake {{dose}}.",
]


def test_placeholders_by_their_context(spark):
    df = spark.createDataFrame(list(enumerate(EXPLAINED + UNFILLED)), "doc_id long, text string")
    got = {r.doc_id for r in residue.find_residue(df).where("placeholder").collect()}
    assert got == set(range(len(EXPLAINED), len(EXPLAINED + UNFILLED)))
