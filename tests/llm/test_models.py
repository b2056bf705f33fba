import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspan.llm import pii_terms, ppm, toxicity


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


# Prediction by partial matching


def test_base_score_of_odd_rows(odd, none):
    got = ppm.score(odd).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    tokens = {t: [*t.encode().lower().split(), None] for _, t in rows}
    count = Counter(w for i, t in rows if fold(i) % 10 for w in tokens[t])
    n, v = sum(count.values()), len(count)
    want = sorted((repr(i), fold(i) % 10 == 0, len(tokens[t]), sum(count[w] > 0 for w in tokens[t]), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[t]), 6)) for i, t in rows)
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert ppm.score(none).count() == 0


def trie_of(texts):
    tally = ppm.Tally()
    for codes, _ in ppm.windows(texts):
        tally.add(codes)
    grams = [tally.taken()]
    for k in range(ppm.ORDER - 1, -1, -1):
        keys, at = np.unique(grams[0][0] & np.uint64((1 << (8 * (k + 1))) - 1), return_inverse=True)
        grams.insert(0, (keys, np.bincount(at, weights=grams[0][1]).astype(np.int64)))
    totals = []
    for codes, counts in grams:
        keys, at = np.unique(codes >> np.uint64(8), return_inverse=True)
        totals.append((keys, np.bincount(at, weights=counts).astype(np.int64)))
    return ppm.Trie(grams, totals), grams, totals


TRAINING = [b"the cat sat on the mat", b"the dog sat on the log", "naïve café".encode(), b"", b"abracadabra abracadabra"]


@pytest.mark.parametrize("least", [1, 2])
def test_probabilities_of_a_context_sum_to_one(least):
    _, grams, totals = trie_of(TRAINING)
    kept = [(k[n >= least], n[n >= least]) for k, n in grams]
    trie = ppm.Trie(kept, totals)
    for context in (b"\xff" * 6, b"on the", b"zzzzzz", b" sat o", b"\xff\xff\xff\xff\xffn", b"cadabr"):
        codes = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** trie.log10(codes)).sum() - 1) < 1e-6
        assert np.allclose(trie.log10(codes), trie.escaped(codes), atol=1e-5)


def plain_ppm(texts, text):
    """The same model, byte by byte with dictionaries."""
    follow = {}
    for t in texts:
        s = b"\xff" * ppm.ORDER + t + b"\xff"
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                follow.setdefault(s[i - k : i], Counter())[s[i]] += 1
    s, total = b"\xff" * ppm.ORDER + text + b"\xff", 0.0
    for i in range(ppm.ORDER, len(s)):
        gone = set()
        for k in range(ppm.ORDER, -1, -1):
            seen = {b: c for b, c in follow.get(s[i - k : i], {}).items() if b not in gone}
            if not seen:
                continue
            mass = sum(seen.values())
            if s[i] in seen:
                total += math.log10((seen[s[i]] - 0.5) / mass)
                break
            total += math.log10(len(seen) / 2 / mass)
            gone |= set(seen)
        else:
            total -= math.log10(256 - len(gone))
    return total


def test_scores_equal_a_plain_model():
    trie, *_ = trie_of(TRAINING)
    texts = [b"the cat", b"", b"quick brown", "café naïf".encode(), b"abracadabra", b"the dog sat on the log"]
    assert np.allclose(trie.score(texts), [plain_ppm(TRAINING, t) for t in texts], atol=1e-4)


def test_windows_are_whole_across_segments(monkeypatch):
    text = bytes(range(1, 200)) * 20
    whole, _ = map(np.concatenate, zip(*ppm.windows([b"ab", text, b""]), strict=True))
    monkeypatch.setattr(ppm, "STEP", 64)
    parts, owner = map(np.concatenate, zip(*ppm.windows([b"ab", text, b""]), strict=True))
    assert (whole == parts).all() and np.bincount(owner).tolist() == [3, len(text) + 1, 1]


# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(t):
    digits = lambda m: "".join(c for c in m[0] if c.isdigit())
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


PARTS = st.lists(st.sampled_from([*"ab.@@-+%_0123456789  ().\né", "1.2.3.4", "a@b.c", "+1 (234) 555-1234", "4111111111111111", "4111 1111 1111 1111", "255.0.0.256", "0000.1.2.3"]), max_size=25).map("".join)


@settings(max_examples=1500, deadline=None)
@given(PARTS)
def test_base_spans_equal_the_plain_patterns(text):
    assert pii_terms.base_spans(text) == plain_spans(text)


def test_base_patterns_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1" + "-" * 200_000, "1.2." * 50_000):
        pii_terms.base_spans(text)


def test_personal_data_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    want = []
    for i, t in rows:
        s = plain_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want.append((i, *(sum(x[0] == k for x in s) for k in pii_terms.KINDS), hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert sorted(map(tuple, pii_terms.personal_data(odd).collect()), key=repr) == sorted(want, key=repr)
    assert pii_terms.personal_data(none).count() == 0


def test_terms_that_disclose_are_found_and_taken_out(spark):
    filler = [f"plain text number {k} about nothing in particular with other words" for k in range(60)]
    texts = [*filler, "please write to Quentin Zarro at q.zarro@mail.org today", "the old letter by Zarro names q.zarro@mail.org again", "Zarro is not named near an address, yet words are with him here at all"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s.split(":")[0], texts[r["doc_id"]][slice(*map(int, s.split(":")[1:]))]) for s in r["spans"].split(",")] for r in pii_terms.personal_data(d).where("spans <> ''").collect()}
    assert got == {60: [("email", "q.zarro@mail.org"), ("term", "Zarro")], 61: [("email", "q.zarro@mail.org"), ("term", "Zarro")], 62: [("term", "Zarro")]}
    clean = {r["doc_id"]: r["text"] for r in pii_terms.sanitise(d).collect()}
    assert clean[60] == "please write to Quentin [NAME] at [EMAIL] today"
    assert clean[62] == "[NAME] is not named near an address, yet words are with him here at all"
    assert [clean[k] for k in range(60)] == filler


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a@b.cd", "x", "İz", "don't", "+1 (234) 555-1234", "1.2.3.4", "4111 1111 1111 1111", ",", "é-f", "y" * 70]), max_size=30).map(" ".join), st.integers(0, 3))
def test_near_terms_equal_a_plain_search(text, window):
    base = plain_spans(text)
    free = [m.span() for m in pii_terms.TERM.finditer(text) if not any(m.start() < b and a < m.end() for _, a, b in base)]
    assert pii_terms.free_terms(text, base) == free
    want = []
    for kind, a, b in base:
        left, right = [f for f in free if f[1] <= a], [f for f in free if f[0] >= b]
        want += [(pii_terms.entity(kind, text[a:b]), pii_terms.key_of(text[c:d]), c, d) for c, d in (left[-window:] if window else []) + right[:window]]
    assert [x[:4] for x in pii_terms.near_terms(text, base, window)] == want


def test_many_spans_and_far_terms_take_little_time():
    text = "word " * 20 + "mail " + " ".join(f"n{k}@m.org" for k in range(40_000)) + " " * 2_000 + "end"
    near = pii_terms.near_terms(text, pii_terms.base_spans(text), 5)
    assert len(near) == 40_000 * 6 and near[-1][1] == "end"


def test_terms_of_any_length_and_case_disclose(spark, monkeypatch):
    long, texts = "Zar" + "o" * 500, [f"plain text number {k} about nothing in particular" for k in range(60)]
    for name, address in ((long, "q@m.org"), ("İstanbulo", "i@m.org")):
        texts += [f"ask {name} or {address} now", f"by {address} came {name} too", f"then {name} alone"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, pii_terms.sanitise(d).collect()))
    assert [t for k, t in want if k in (62, 65)] == ["then [NAME] alone"] * 2
    rows = sorted(map(tuple, pii_terms.personal_data(d).collect()))
    monkeypatch.setattr(pii_terms, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, pii_terms.sanitise(d).collect())) == want and sorted(map(tuple, pii_terms.personal_data(d).collect())) == rows


def test_disclosure_equals_a_plain_count(spark):
    rng = np.random.default_rng(6)
    words = [f"t{k}" for k in range(30)]
    texts = [" ".join(rng.choice(words, 12)) + (f" {'xyz'[k % 3]}only e{k % 4}@m.org {rng.choice(words)}" if k % 2 else "") for k in range(120)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii_terms.scan(d, 3).cache()
    got = {(r["entity"], r["term"]): r["disclosure"] for r in pii_terms.disclosing(found, 0.3, 2).collect()}
    near, having, frequency, contexts = Counter(), Counter(), Counter(), {}
    for t in texts:
        spans = plain_spans(t)
        # An address is made of terms too, so they count for the frequencies.
        frequency.update(set(re.findall(r"[^\W_]+", t)))
        pairs = set()
        for _, a, b in spans:
            around = re.findall(r"\w+", t[:a])[-3:] + re.findall(r"\w+", t[b:])[:3]
            pairs |= {("email:" + t[a:b], w) for w in around}
            for w in around:
                contexts.setdefault(("email:" + t[a:b], w), set()).add(tuple(around))
        near.update(pairs)
        having.update({"email:" + t[a:b] for _, a, b in spans})
    want = {}
    for (e, w), n in near.items():
        share = math.log(len(texts) * n / (frequency[w] * having[e])) / math.log(len(texts) / having[e])
        if n >= 2 and len(contexts[e, w]) > 1 and share >= 0.3:
            want[e, w] = share
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sanitising_keeps_rows_and_columns(odd, none):
    got = pii_terms.sanitise(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    before, after = ({r["doc_id"]: r for r in x.where("doc_id in (4, 5, 11, 12)").collect()} for x in (odd, got))
    assert after[11]["text"] == "mail [EMAIL] or [PHONE], [IP] and [CARD]" and after[11]["n_chars"] == len(after[11]["text"])
    assert after[4]["text"] is None and after[5] == before[5] and after[12] == before[12]
    assert pii_terms.sanitise(none).count() == 0


# Toxicity


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"term{k}x" for k in range(300)]
    bad = ["vilest", "hateful", "rotten", "dreck"]
    texts, y = [], []
    for _ in range(n):
        t = list(rng.choice(words, rng.integers(5, 60)))
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.integers(1, 4)):
                t.insert(rng.integers(len(t)), str(rng.choice(bad)))
            t.insert(0, "you")
        texts.append(" ".join(t))
        y.append(int(toxic))
    return texts, np.array(y)


def test_held_out_accuracy(spark):
    texts, y = labelled(1500, 1)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = toxicity.toxicity(d, spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, toxic int")).collect()
    assert len(got) == 1500 and all(r["held_out"] == (fold(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == y[r["doc_id"]] for r in held) / len(held) > 0.97


def test_held_out_labels_don_t_matter(spark):
    texts, y = labelled(400, 2)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flipped = [(k, int(v) if fold(k) % 5 else 1 - int(v)) for k, v in enumerate(y)]
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in ([(k, int(v)) for k, v in enumerate(y)], flipped))
    assert a == b


def test_toxicity_of_odd_rows(spark, odd, none):
    for labels in ([], [(1, 1)], [(k, k % 2) for k in range(14)] + [(None, 1), (3, None)]):
        rows = toxicity.toxicity(odd, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert rows.count() == odd.count() and rows.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_calibration_is_monotone_and_pools():
    rng = np.random.default_rng(1)
    score = rng.normal(size=500)
    label = (rng.random(500) < 1 / (1 + np.exp(-score))).astype(float)
    fitted = toxicity.Isotonic().fit(score, label)
    assert (np.diff(fitted(np.sort(score))) >= 0).all() and abs(fitted(score).mean() - label.mean()) < 1e-9


def test_calibration_equals_the_minimax_form():
    rng = np.random.default_rng(4)
    score, label = rng.integers(0, 12, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    fitted, steps = toxicity.Isotonic().fit(score, label), np.unique(score)
    mean = {(a, b): label[(score >= a) & (score <= b)].mean() for a in steps for b in steps if a <= b}
    for x in steps:
        assert abs(fitted(np.array([x]))[0] - max(min(mean[a, b] for b in steps if b >= x) for a in steps if a <= x)) < 1e-12


def test_a_tree_equals_a_plain_split_search():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, (120, 4)).astype(float), rng.integers(0, 2, 120).astype(float)
    trees = toxicity.Trees(rounds=2, depth=2, bins=8, least=5).fit(x, y)
    raw = np.full(120, np.log(y.mean() / (1 - y.mean())))
    for _ in range(2):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        score = lambda own: g[own].sum() ** 2 / (h[own].sum() + 1)

        def grow(own, depth):
            best = (1e-6, None, None)
            for k in range(4 if depth and len(own) >= 10 else 0):
                for edge in trees.edges[k]:
                    left, right = own[x[own, k] <= edge], own[x[own, k] > edge]
                    if min(len(left), len(right)) >= 5 and (gain := score(left) + score(right) - score(own)) > best[0] + 1e-12:
                        best = (gain, left, right)
            if best[1] is None:
                raw[own] -= trees.rate * g[own].sum() / (h[own].sum() + 1)
            else:
                grow(best[1], depth - 1)
                grow(best[2], depth - 1)

        grow(np.arange(120), 2)
    assert np.allclose(trees.raw(x), raw)


def test_features_of_other_scripts():
    at, own = toxicity.NAMES.index, toxicity.Lexicon({"дурак": 2.0})
    got = toxicity.features("Ты ДУРАК, иди! \u6f22\u5b57 \U0001f600", own)
    assert got[at("hits")] == 1 and got[at("shouted")] > 0 and abs(got[at("capitals")] * 19 - 6) < 1e-9 and abs(got[at("punctuation")] * 19 - 3) < 1e-9
    latin, cyrillic = toxicity.features("Aba caba", own), toxicity.features("Аба каба", own)
    assert latin == cyrillic


def test_toxic_texts_go_and_all_others_stay(spark, odd, none):
    texts, y = labelled(600, 5)
    d = spark.createDataFrame([(None if k % 9 == 0 else k, t, k) for k, t in enumerate(texts)] + [(7000, None, 7000), (7001, "", 7001)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(d, labels)
    assert kept.columns == d.columns
    got = {r["score"] for r in kept.collect()}
    assert {7000, 7001} <= got and sum((k in got) != y[k] for k in range(600)) / 600 > 0.97
    assert toxicity.without_toxic(none, labels).count() == 0


def test_disguised_and_addressed_terms_show():
    lexicon = toxicity.Lexicon({"idiot": 3.0})
    at = toxicity.NAMES.index
    plain, told = toxicity.features("an old tale", lexicon), toxicity.features("You 1d1ot, idiot!!! YOU AAAARGH", lexicon)
    assert not any(plain[1:12]) and told[at("hits")] == 1 and told[at("near_hits")] == 1 and told[at("disguised_hits")] == 1 and told[at("shouted")] > 0 and told[at("repeated")] > 0
    assert toxicity.features("", lexicon) == [0.0] * len(toxicity.NAMES)
