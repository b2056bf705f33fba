import re
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from veilspan.functions.matching import all_matches, whole_word
from veilspan.operators import dictionary, model_layer, names, patterns
from veilspan.plans.detect import detect, layer_tallies
from veilspan.queries import CASES, NOTE
from veilspan.sources.models import Replies


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(frame):
    return sorted((r["doc_id"], r["start"], r["end"], r["text"], r["type"]) for r in frame.collect())


@pytest.fixture(scope="module")
def note(spark):
    return table(spark, [NOTE])


def test_patterns_of_the_note(note):
    rows = patterns.detect_patterns(note).orderBy("start").collect()
    assert [(r["text"], r["type"], r["normalized_value"]) for r in rows] == [
        ("CR-10442-AC", "ID_NUMBER", None), ("0413 555 760", "PHONE", "0413555760"), ("+61 413 555 760", "PHONE", "61413555760"), ("anna.h@mail.example.org", "EMAIL", "anna.h@mail.example.org"),
    ]
    assert all(NOTE[r["start"] : r["end"]] == r["text"] and r["confidence"] == 0.99 and r["source"] == "regex" and r["id"] == f"regex:{r['start']}-{r['end']}" for r in rows)


def test_precedence_cases(spark):
    got = {}
    for r in patterns.detect_patterns(spark.createDataFrame(CASES, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["type"]))
    assert got[1] == [("123-45-6789", "PHONE")]  # a lone social security number is phone-shaped
    assert ("123-45-6789", "ID_NUMBER") in got[2]  # it stands where the phone run is too long
    assert got[3] == [("4111 1111 1111 1111", "ID_NUMBER"), ("3782-822463-10005", "PHONE")]
    assert [t for t, _ in got[4]] == ["CR-77120-AC", "X1-Y2-Z3", "AB-12"]
    assert ("2024-03-05 12", "PHONE") in got[5] and ("Ana.Li@Mail.example.org", "EMAIL") in got[5]
    assert ("0413\n552 760", "PHONE") in got[6]
    assert 7 not in got


PIECES = st.lists(st.sampled_from([*"0123456789 -.()+\nAbZ@é\U0001f600", "0413 552 760", "AB-12", "a@b.co", "4111111111111111", "123-45-6789"]), max_size=14).map("".join)


def plain_layer(text):
    def luhn(d):
        return 13 <= len(d) <= 19 and sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0

    out = [(0, m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", text)]
    out += [(1, m) for m in re.finditer(r"\+?\d[\d\s().\-]{7,}\d", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    out += [(2, m) for m in re.finditer(r"\b\d{3}-\d{2}-\d{4}\b", text)]
    out += [(2, m) for m in re.finditer(r"\b\d[\d \-]{11,21}\d\b", text) if luhn(re.sub(r"\D", "", m[0]))]
    out += [(3, m) for m in re.finditer(r"\b[A-Z0-9]+(?:-[A-Z0-9]+)+\b", text) if re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])]
    kept = []
    for _, m in sorted(out, key=lambda x: (x[0], x[1].start() - x[1].end(), x[1].start())):
        if all(m.end() <= a or b <= m.start() for a, b in kept):
            kept.append(m.span())
    return sorted(kept)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PIECES, min_size=150, max_size=150))
def test_layer_equals_a_plain_scan(spark, texts):
    got = {}
    for r in patterns.detect_patterns(table(spark, texts)).collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["text"]
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    assert [sorted(got.get(k, [])) for k in range(len(texts))] == [plain_layer(t) for t in texts]


def test_dictionary_terms(spark):
    d = table(spark, ["Ann and ANN, not Annabel; éann ann's a.b A.B", "", "ann ann", "x (Ltd) y"])
    terms = [("ann", "PERSON"), ("", "ORG"), ("a.b", "OTHER"), ("ann ann", "ORG"), ("Ann", "OTHER")]
    inline = found(dictionary.detect_known(d, terms))
    assert [(i, t, k) for i, _, _, t, k in inline if k == "PERSON"] == [(0, "Ann", "PERSON"), (0, "ANN", "PERSON"), (0, "ann", "PERSON"), (2, "ann", "PERSON"), (2, "ann", "PERSON")]
    assert sum(k == "OTHER" and t in ("a.b", "A.B") for _, _, _, t, k in inline) == 2
    named = spark.createDataFrame([(k, t, kind) for k, (t, kind) in enumerate(terms)], "ord int, term string, type string")
    assert found(dictionary.detect_known(d, named)) == inline
    assert dictionary.parse_entities(["a:b:PERSON"]) == [("a:b", "PERSON")]
    with pytest.raises(ValueError):
        dictionary.parse_entities(["a:THING"])


def test_default_allowlist(note):
    r = dictionary.allow_ranges(note).collect()
    assert [NOTE[x["start"] : x["end"]] for x in r] == ["Coastline Mutual"]


def test_names_of_the_note(note):
    got = [(r["text"], r["type"]) for r in names.detect_names(note, dictionary.allow_ranges(note)).orderBy("start").collect()]
    assert got == [("Anna Hartwell", "PERSON"), ("27 Riverbank Street, Newtown NSW 2042", "ADDRESS"), ("Martin Sorvik", "PERSON"), ("Anna", "PERSON")]
    loose = {r["text"] for r in names.detect_names(note).collect()}
    assert any("Coastline Mutual" in t for t in loose)


def test_suppression_comes_before_overlaps(spark):
    d = table(spark, ["Alpha Beta Gamma met"])
    ranges = spark.createDataFrame([(0, 0, 5)], "doc_id long, start int, end int")
    both = (names.Recogniser("PERSON", "Alpha Beta Gamma", 0.9), names.Recogniser("PERSON", "Gamma", 0.7), names.Recogniser("ANIMAL", "met", 0.9))
    assert [r["text"] for r in names.detect_names(d, ranges, recognisers=both).collect()] == ["Gamma"]
    got = names.detect_names(d, recognisers=both).collect()
    assert [(r["text"], r["confidence"]) for r in got] == [("Alpha Beta Gamma", 0.85)]


def test_a_long_text_doesn_t_end_the_matcher(spark):
    d = table(spark, ["12 Long " + "word " * 20_000 + "Street 1234", "A1" + "-B2" * 20_000])
    assert names.detect_names(d).count() >= 0 and patterns.detect_patterns(d).count() >= 0


@pytest.mark.parametrize("size", [0, 1, 800, 801, 886, 1480, 1481, 5000])
def test_windows_cover_a_text(spark, size):
    text = "".join(chr(97 + k % 26) for k in range(size))
    got = model_layer.text_windows(table(spark, [text])).orderBy("w_start").collect()
    want, at = [], 0
    while at < size:
        want.append((at, text[at : at + 800]))
        if at + 800 >= size:
            break
        at += 680
    assert [(r["w_start"], r["chunk"]) for r in got] == want


class Counting:
    def complete(self, *, system, user):
        raise RuntimeError("down")


def test_model_layer(spark, note):
    reply = '{"entities": [{"text": "Martin Sorvik", "type": "PERSON", "reason": "x"}, {"text": "Nobody Here"}, {"text": "0413 555 760", "type": "PHONE"}]}'
    client = Replies({"supervisor": reply})
    hits = model_layer.detect_with_model(note, client, covered=patterns.detect_patterns(note)).collect()
    assert [(r["text"], r["type"], r["confidence"], r["reason"]) for r in hits] == [("Martin Sorvik", "PERSON", 0.55, "x")]
    assert model_layer.detect_with_model(table(spark, ["plain words only"]), Counting()).count() == 0  # the gate spares the call
    assert model_layer.detect_with_model(note, Replies(otherwise="not json")).count() == 0
    failed = detect(note, client=Counting())
    report = {r["name"]: (r["status"], r["detail"]) for r in failed.layers.collect()}
    assert report["llm"] == ("error", "unavailable (RuntimeError)") and failed.findings.count() > 0


def test_settled_disagreements(spark, note):
    at = NOTE.index("Coastline Mutual")
    disputed = spark.createDataFrame([(0, at, at + 16)], "doc_id long, start int, end int")
    yes = Replies(otherwise='```json\n{"is_pii": true, "type": "ORG", "reason": " "}\n```')
    got = model_layer.settle_disagreements(note, disputed, yes).collect()
    assert [(r["id"], r["text"], r["type"], r["reason"]) for r in got] == [(f"llm:{at}-{at + 16}", "Coastline Mutual", "ORG", model_layer.SETTLED_REASON)]
    for no in ('{"is_pii": false}', "what?"):
        assert model_layer.settle_disagreements(note, disputed, Replies(otherwise=no)).count() == 0


def test_whole_pipeline(note):
    d = detect(note, client=Replies({"supervisor": '{"entities": [{"text": "her supervisor", "type": "OTHER"}]}'}))
    rows = {r["text"]: r for r in d.findings.collect()}
    assert rows["0413 555 760"]["tier"] == 1 and [tuple(o) for o in rows["0413 555 760"]["linked"]] == [(rows["+61 413 555 760"]["start"], rows["+61 413 555 760"]["end"])]
    assert rows["her supervisor"]["tier"] == 3 and rows["Martin Sorvik"]["tier"] == 2 and "Coastline Mutual" not in rows
    report = {r["name"]: (r["status"], r["count"]) for r in d.layers.collect()}
    assert report == {"regex": ("ok", 4), "dictionary": ("ok", 0), "ner": ("ok", 4), "llm": ("ok", 1)}
    assert tuple(layer_tallies(d.layers).first())[1:] == (4, 0, 0)


def test_texts_are_searched_wherever_a_pattern_could_match(spark):
    """The cheap conditions before a search leave out no match: odd letters that equal ASCII ones, empty and null texts."""
    terms = [("Stella Kim", "PERSON"), ("iris", "PERSON"), ("été", "ORG"), ("k-2", "OTHER")]
    texts = ["STELLA KIM and stella kim", "\u017ftella \u212aim", "\u0130R\u0130S, \u0131ris, IRIS", "ÉTÉ", "\u212a-2 K-2", "stella", "", None]
    rows = table(spark, texts)
    gated = rows.select("doc_id", dictionary.known_rows("text", terms).alias("x")).collect()
    plain = rows.select("doc_id", *[all_matches("text", whole_word(t)).alias(f"t{k}") for k, (t, _) in enumerate(terms)]).collect()
    for g, p in zip(gated, plain, strict=True):
        want = sorted((m["start"], m["end"], m["text"]) for k in range(len(terms)) for m in p[f"t{k}"] or [])
        assert sorted((m["start"], m["end"], m["text"]) for m in g["x"] or []) == want
    assert [len(r["x"] or []) for r in gated] == [2, 1, 3, 1, 2, 0, 0, 0]

    cues = ["his wife, Ann Smith, left", "wife Ann Smith", "Dr. Weber", "Ms Weber", "Prof Weber", "Weber Mutual", "WeberMutual", "12 Long Hill Terrace, X 1234", "a@b.de", "a at b.de", ""]
    rows = table(spark, cues)
    bare = [replace(r, needs=()) for r in names.DEFAULT_RECOGNISERS]
    for row in rows.select(names.pattern_results("text").alias("g"), names.pattern_results("text", bare).alias("p"), patterns.emails("text").alias("e"), all_matches("text", patterns.EMAIL).alias("a")).collect():
        assert row["g"] == row["p"] and len(row["e"]) == len(row["a"])
