"""Each operator against brute force, and with nulls, empty and very long texts, ties, repeats, empty tables and clashing
names."""

import base64
import itertools
import math
import random
import re

import numpy as np
import pytest

from siftline.llm import canonical, leaks, mixing, neardup, personal, segments, similar, spam, survivors
from siftline.llm import queries as Q
from siftline.llm import words as W

rnd = random.Random(3)
VOCAB = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


# near duplicates


def changed(t, k, seed):
    r = random.Random(seed)
    ws = t.split()
    for _ in range(k):
        ws[r.randrange(len(ws))] = "changed" + str(r.randrange(999))
    return " ".join(ws)


def jaccard(a, b, k):
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (re.findall(r"\w+", x.lower()) for x in (a, b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 0.0


@pytest.mark.parametrize("k, threshold", [(3, 0.7), (5, 0.8)])
def test_near_duplicates_equal_brute_force(spark, k, threshold):
    rows = [(i, text(rnd.randint(60, 200), i)) for i in range(30)]
    for i in range(30):
        rows += [(100 + 10 * i + j, changed(rows[i][1], j * 2, i * 7 + j)) for j in range(4)]
    rows += [(900, None), (901, ""), (902, "two words"), (None, rows[0][1]), rows[3], (903, "…!?"), (904, text(40_000, 77))]
    df = spark.createDataFrame([(a, b, a, "x") for a, b in rows], "id int, t string, key int, class string")
    members, links = neardup.near_duplicates(df, "id", "t", k=k, threshold=threshold)
    got = {(r["a"], r["b"]) for r in neardup.all_pairs(members, links).collect()}
    full = {a: b for a, b in rows if a is not None and b and len(b.split()) >= k and a != 904}
    want = {(a, b) for a, b in itertools.combinations(sorted(full), 2) if jaccard(full[a], full[b], k) >= threshold}
    assert got == want and len(want) > 60
    assert links.where("jaccard < %f" % threshold).count() == 0


def test_near_duplicate_groups(spark):
    base = text(300, 5)
    chain = [base]
    for i in range(6):
        chain.append(changed(chain[-1], 4, i))
    rows = [(i, t) for i, t in enumerate(chain)] + [(50, base), (60, text(100, 9)), (70, None)]
    got = {r["key"]: r for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert {got[i]["group"] for i in (*range(7), 50)} == {0} and got[50]["class"] == 0
    assert got[60]["group"] == 60 and got[60]["links"] == 0 and 70 not in got
    assert neardup.near_duplicate_groups(spark.createDataFrame([], "id int, t string"), "id", "t").count() == 0


def test_superminhash_estimates_jaccard():
    g = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        x = g.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = np.unique(x[:220]), np.unique(x[80:])
        s = neardup.superminhash([a, b], 200)
        errors.append((s[0] == s[1]).mean() - 140 / 300)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04
    one = neardup.superminhash([np.array([7], np.uint64)], 256)
    assert len(np.unique(one >> np.uint64(56))) == 256  # one element fills each slot with a rank of its own


# vectors


def test_vantage_tree_exact_and_relaxed():
    g = np.random.default_rng(1)
    x = g.normal(size=(3000, 24))
    x[1500:] = x[:1500] + 0.1 * g.normal(size=(1500, 24))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    true = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9)) if i != j}
    tree = similar.VantageTree(x, leaf=64)
    q, b, _ = tree.search(x, 0.9, 1.0)
    assert true <= set(zip(q.tolist(), b.tolist()))
    q, b, _ = tree.search(x, 0.9, 0.2)
    pairs = set(zip(q.tolist(), b.tolist()))
    assert np.mean([(i, j) in pairs or (j, i) in pairs for i, j in true]) > 0.95


def test_similar_keys_equal_brute_force(spark):
    g = np.random.default_rng(2)
    base = g.normal(size=(80, 16))
    vecs = {f"k{i:03d}": base[i % 80] * (1 + i % 3) + (i >= 80) * 0.08 * g.normal(size=16) for i in range(400)}
    for i in range(12):
        vecs[f"z{i:02d}"] = base[0] * 2  # equal vectors
    rows = [("m", k, [float(z) for z in v], 1.0) for k, v in vecs.items()]
    rows += rows[:5] + [("m", "bad1", None, 1.0), ("m", "bad2", [], 1.0), ("m", "bad3", [0.0] * 16, 1.0), ("m", "bad4", [1.0] * 8, 1.0), ("m", None, [1.0] * 16, 1.0), ("n", "k000", [1.0, 2.0], 1.0), ("n", "k001", [1.0, 2.1], 1.0)]
    df = spark.createDataFrame(rows, "grp string, id string, v array<float>, cosine double")
    units = similar.usable(df, "grp", "id", "v")
    got = {(r["grp"], r["key"], r["other"]) for r in similar.similar_keys(units, 0.9, factor=1.0, route_factor=1.0, shards=4, leaf=40).collect()}
    keys = sorted(vecs)
    x = np.stack([np.float32(vecs[k]).astype(float) for k in keys])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)
    c = np.round(x @ x.T, 9)
    want = set()
    for i, k in enumerate(keys):
        order = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (-c[i, j], keys[j]))
        want |= {("m", k, keys[j]) for j in order[:5] if c[i, j] >= 0.9}
    assert {x for x in got if x[0] == "n"} == {("n", "k000", "k001"), ("n", "k001", "k000")}
    mine = {x for x in got if x[0] == "m"}
    assert len(mine ^ want) <= 0.005 * len(want) and len(want) > 500  # equal cosines may differ in the last digit
    assert similar.similar_keys(similar.usable(df.limit(0), "grp", "id", "v"), 0.9).count() == 0


def test_nearest_reference(spark):
    df = spark.createDataFrame([("m", "a", [1.0, 0.1]), ("m", "b", [-1.0, 0.0]), ("m", "a", [1.0, 0.1])], "grp string, id string, v array<float>")
    u = similar.usable(df, "grp", "id", "v")
    ref = spark.createDataFrame([("x", [2.0, 0.0]), ("w", [1.0, 0.0]), ("y", [0.0, 1.0]), ("null", None), ("zero", [0.0, 0.0]), ("long", [1.0, 0.0, 0.0])], "key string, vec array<double>")
    for size in (1, 1 << 20):  # one entry in a block, all in one
        assert {(r["key"], r["ref"]) for r in similar.nearest_reference(u, ref, "key", "vec", 0.8, 2, block_bytes=size).collect()} == {("a", "w")}
    assert similar.nearest_reference(u, ref.limit(0), "key", "vec", 0.8, 2).count() == 0


def test_router_copies_and_recall():
    g = np.random.default_rng(4)
    x = g.normal(size=(12_000, 48))
    x[6000:] = x[:6000] + 0.2 * g.normal(size=(6000, 48))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    router = similar.Router(x[:4000], 30, 0.02)
    home = np.empty(len(x), int)
    for s, rows in enumerate(router.route(x, 0.0)):
        home[rows] = s
    near = [set(rows.tolist()) for rows in router.route(x, math.sqrt(0.2))]  # the whole radius: exact
    true = [(i, j) for i, j in zip(*np.nonzero(x[:500] @ x.T >= 0.9)) if i != j]
    assert len(true) > 100 and all(i in near[home[j]] for i, j in true)
    assert router.leaves == len(near) > 100 and len(np.unique(home)) > 100
    assert similar.Router(np.ones((50, 4), np.float32), 5, 0.1).leaves == 1


# canonical names


TERMS = [(1, "Data Engineer", ["ETL Developer"], "x"), (2, "Scrum Master", None, "x"), (3, "Accountant", [], "x"), (4, "Sales Manager", ["Sales Lead"], "x"), (5, "C++", ["cpp"], "x"), (6, "Network Engineer", [], "x"), (7, "Business Analyst", [], "x")]
#: Values that show what is written around names: each wording with three terms, some with another end every time.
AROUND = [f"{w}{n}" for w in ("currently ", "Title - ", "sr. ", "good knowledge of ") for n in ("Data Engineer", "Accountant", "Scrum Master", "C++")] + [f"{n}{w}" for w in (" (m/f/d)", " III", " (advanced)") for n in ("Data Engineer", "Accountant", "Scrum Master")]
AROUND += [f"{n}{w}{i}" for w in (", Acme ", " at Acme ") for i, n in zip(("Foods", "Hotels", "Energy"), ("Data Engineer", "Accountant", "Sales Manager"), strict=True)] + ["Accountant - Level 3", "Data Engineer - level 1", "Scrum Master - Level 2"]


def _canonical(spark, values, around=AROUND):
    ref = spark.createDataFrame(TERMS, "id int, name string, aliases array<string>, value string")
    df = spark.createDataFrame([(v, 1) for v in [*values, *around]], "value string, term int")
    return {r["value"]: (r["term"], r["edits"]) for r in canonical.canonical(df, "value", ref, "id", "name", "aliases").collect() if r["value"] in values}


def test_canonical(spark):
    want = {
        "Data Engineer": 1, "currently  DATA engineer (m/f/d)": 1, "Engineer (Data)": 1, "Engineer - Data, Acme Foods": 1, "Sr. Etl Dev.": 1, "Data Engr": 1, "Dtaa Enginer": 1, "Scrum-Master": 2, "Master, Scrum": 2,
        "Accuontant": 3, "ACCOUNTANT, Acme Ltd": 3, "Sales Lead III": 4, "Stage Manager": None, "Falconer": None, "": None, "-": None, "x" * 20_000: None, "Network Marketing Guide": None,
    }
    got = _canonical(spark, [*want, None, "Falconer"])
    assert {k: v[0] for k, v in got.items()} == want
    assert _canonical(spark, [], []) == {}
    assert _canonical(spark, ["good knowledge of CPP", "c++ (advanced)", "C#"]) == {"good knowledge of CPP": (5, 0), "c++ (advanced)": (5, 0), "C#": (None, None)}


def test_wordings_are_learned_from_the_values(spark):
    """A wording counts once the values show it with three terms; short words, slips in them and wordings in wordings too."""
    odd = ["formerly known as Accountant", "Acountant of note", "Analyst in spe"]
    assert {v: t for v, (t, _) in _canonical(spark, odd).items()} == {v: None for v in odd}
    shown = [f"formerly known as {n}" for n in ("Data Engineer", "Scrum Master", "Sales Manager")] + [f"{n} of note" for n in ("Data Engineer", "Scrum Master", "Sales Manager")]
    got = _canonical(spark, [*odd, "formerly known as currently Scrum Master", "formerly kown as Data Engineer"], [*AROUND, *shown])
    assert {v: t for v, (t, _) in got.items()} == {"formerly known as Accountant": 3, "Acountant of note": 3, "Analyst in spe": None, "formerly known as currently Scrum Master": 2, "formerly kown as Data Engineer": 1}
    short = _canonical(spark, ["Netwrok Engr", "Data Engr", "Network Engr", "Bus. Analyst"])
    assert {v: t for v, (t, _) in short.items()} == {"Netwrok Engr": 6, "Data Engr": 1, "Network Engr": 6, "Bus. Analyst": 7}


def test_pigeonhole_finds_all_within_edits(spark):
    names = [f"{VOCAB[i]}{VOCAB[i + 1]}" for i in range(0, 120, 2)]
    typed = []
    for i, n in enumerate(names):
        r = random.Random(i)
        for _ in range(4):
            s = list(n)
            for _ in range(r.randint(0, canonical.EDITS)):
                p, op = r.randrange(len(s)), r.randrange(3)
                s[p : p + 1] = [[], [r.choice("xyz")], [s[p], r.choice("xyz")]][op]
            typed.append("".join(s))
    known = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "term int, key string")
    keys = spark.createDataFrame([(t,) for t in set(typed)], "key string")
    met = {(r["key"], r["form"]) for r in canonical.probes(keys).join(canonical.segments(known), "probe").select("key", "form").distinct().collect()}
    lev = lambda a, b: _levenshtein(a, b)
    assert all((t, n) in met for t in set(typed) for n in names if abs(len(t) - len(n)) <= canonical.EDITS and lev(t, n) <= canonical.EDITS)


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


# personal details

TEXT = """# Elif Wexcombe
Data Engineer

Signed, WEXCOMBE, Elif
Contact me at elif.wexcombe [at] example dot org or +49 30 23125 375
Identification: SSN 990-83-7432
Referee: Imran Drosk (x.y@mail.example)
Address: Flat 14, 8 Millpond Close, Pellham
ISBN 978-0-00-8664-677, order 9306-12-814, Version 10.24.510 of 12.05.2024
Materials Notes, 18 (2009) 1148-962
Reported to the head of office at Brackwater Hotels since 10
Reported to [name] at Acme, call [phone]"""


def test_detect_lines(spark):
    rows = [("d", i, TEXT, "k") for i in range(6)] + [("d", 90, None, "k"), ("d", 91, "", "k"), ("d", 0, TEXT, "k"), ("d", 92, "word " * 60_000, "k"), ("d", 93, "Data Engineer\nSome Heading", "k")]
    df = spark.createDataFrame(rows, "tbl string, no int, t string, kind string")
    got = {(r["no"], r["line"], r["kind"]) for r in personal.found_lines(df, ["tbl", "no"], "t").collect()}
    want = {(i, line, kind) for i in range(6) for line, kind in ((1, "person"), (4, "person"), (5, "email"), (5, "phone"), (6, "id_number"), (7, "person"), (7, "email"), (8, "address"))}
    assert got == want
    assert personal.found_lines(df.limit(0), ["tbl", "no"], "t").count() == 0


def test_masked_keeps_the_rest(spark):
    rows = [(i, TEXT) for i in range(6)] + [(7, None), (8, ""), (9, "nothing here\r\n")]
    df = spark.createDataFrame(rows, "no int, t string")
    got = {r["no"]: r for r in personal.masked(df, ["no"], "t").collect()}
    assert got[7]["text"] is None and got[8]["text"] == "" and got[9]["text"] == "nothing here\r\n"
    lines = got[0]["text"].split("\n")
    assert lines[0] == "# [name]" and lines[1] == "Data Engineer" and lines[4] == "Contact me at [email] or [phone]"
    assert lines[5] == "Identification: SSN [id]" and lines[6] == "Referee: [name] ([email])" and lines[7] == "Address: [address]"
    assert lines[8:] == TEXT.split("\n")[8:] and got[0]["details"] == 8
    again = {r["no"]: r["text"] for r in personal.masked(df, ["no"], "t", surrogate_key=b"k").collect()}
    assert again[7] is None and again[8] == "" and not re.search("millpond|pellham|drosk|990-83", again[0].lower())
    s = again[0].split("\n")
    first, last = re.match(r"# (\w+) (\w+)$", s[0]).groups()
    assert s[3] == f"Signed, {last.upper()}, {first}" and "Wexcombe" not in again[0]
    assert re.search(r"\+49 \d\d \d{5} \d{3}$", s[4]) and again[0] != again[1]


def test_surrogates_are_distinct():
    s = personal.Surrogates(b"key", "r")
    values = [f"+49 30 {i:05d} 1" for i in range(300)]
    made = [s.of("phone", v) for v in values]
    assert len(set(made)) == 300 and made == [s.of("phone", v) for v in values]
    assert s.of("person", "Anna Lee").split()[-1] == s.of("person", "A. Lee").split()[-1]
    for kind, values in {"id_number": range(3000), "person": [f"A{chr(97 + i % 26)}{chr(97 + i // 26)} B" for i in range(600)], "phone": [f"0 {i}" for i in range(200)], "email": [f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"]}.items():
        s = personal.Surrogates(b"key", kind)  # more details than there are surrogates of the format: they get longer
        made = [s.of(kind, str(v)) for v in values]
        assert len({personal.identity(kind, m) for m in made}) == len(made)
        assert all(personal.identity(kind, m) != personal.identity(kind, str(v)) for m, v in zip(made, values))


@pytest.mark.parametrize("value, keeps, gone", [("8 Millpond Close, Pellham", "close", ("millpond", "pellham")), ("8 millpond close, pellham", "close", ("millpond", "pellham")), ("FLAT 3, 22 KING STREET, LONDON SW1A 2AA", "street", ("king", "london", "sw1a")), ("Lindenstraße 14, 04109 Leipzig", "straße", ("linden", "leipzig", "04109")), ("12 rue de la Gare, Lyon", "rue de la", ("gare", "lyon"))])
def test_surrogate_addresses_hide_street_and_town(value, keeps, gone):
    made = personal.Surrogates(b"key", "r").of("address", value)
    assert keeps in made.lower() and not any(w in made.lower() for w in gone)
    assert made.isupper() == value.isupper() and made.islower() == value.islower()


@pytest.mark.parametrize("value", ["Дмитрий Иванов", "Νίκος Παπάς", "王小明", "محمد علي", "Łukasz Żak"])
def test_surrogate_names_keep_the_script(value):
    import unicodedata

    made = personal.Surrogates(b"key", "r").of("person", value)
    script = lambda t: {unicodedata.name(c).split()[0] for c in t if c.isalpha()}
    assert script(made) == script(value) and not set(made.split()) & set(value.split())


# survivors


def test_survivors(spark):
    d = [(1, 10, "a", 100, "2024-01-01", False), (2, 10, "b", 100, "2024-02-01", None), (3, 10, None, None, None, False), (4, 10, "a", 999, None, True), (5, 11, "a", 5, None, False), (6, None, "a", 5, None, False), (7, 12, "a", None, None, False), (8, 12, "b", None, None, False), (1, 10, "a", 100, "2024-01-01", False)]
    docs = spark.createDataFrame(d, "doc_no int, dup_group int, source string, words int, added string, deleted boolean").selectExpr("doc_no", "dup_group", "source", "words", "cast(added as timestamp) added_at", "deleted", "'x' as rate", "'y' as terms")
    facts = spark.createDataFrame([(1, 50.0, "document"), (2, 60.0, "Synthetic"), (3, None, "document"), (4, 9.0, "document"), (1, 50.0, "document"), (None, 1.0, "x")], "doc_no int, rate double, rate_source string")
    claims = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (1, 8), (2, 8), (1, None), (99, 9), (1, 7)], "doc_no int, term_id int")
    got = {r["grp"]: r for r in survivors.survivors(docs, facts, claims).collect()}
    assert set(got) == {10, 12}
    assert (got[10]["text_doc_no"], got[10]["date_doc_no"], got[10]["rate_doc_no"], got[10]["members"]) == (2, 2, 1, 3) and got[10]["terms"] == [7, 8]
    assert (got[12]["text_doc_no"], got[12]["date_doc_no"], got[12]["rate_doc_no"], got[12]["terms"]) == (8, None, None, [])
    assert survivors.survivors(docs.limit(0), facts, claims).count() == 0


def test_source_quality_recovers_truth():
    r = random.Random(5)
    skill = {"good": (0.95, 0.97), "fair": (0.8, 0.9), "bad": (0.4, 0.6), "other": (0.85, 0.95)}
    facts, counts = [], {}
    for _ in range(4000):
        true = r.random() < 0.4
        said = tuple(sorted(s for s, (a, b) in skill.items() if r.random() < (a if true else 1 - b)))
        if said:
            facts.append((said, true))
            counts[said] = counts.get(said, 0) + 1
    patterns = [(s, tuple(sorted(set(skill) - set(s))), n) for s, n in counts.items()]
    quality, prior = survivors.source_quality(patterns)
    p = {x[0]: survivors.posterior(x, quality, prior) for x in patterns}
    right = np.mean([(p[s] >= 0.5) == t for s, t in facts])
    votes = np.mean([(len(s) >= 2) == t for s, t in facts])
    assert right > 0.95 and right > votes
    assert quality["good"][0] > quality["bad"][0] and quality["good"][1] > quality["bad"][1]


def test_source_quality_of_a_table(spark):
    r = random.Random(6)
    claims = [(g, s, v) for g in range(60) for v in range(4) for s in "abcd" if r.random() < (0.7 if v < 2 else 0.15)]
    df = spark.createDataFrame(claims, "grp int, source string, value int")
    members = spark.createDataFrame([(g, s) for g in range(60) for s in "abcd"], "grp int, source string")
    sides = [survivors.true_values(df, members, pattern_limit=limit) for limit in (survivors.PATTERN_LIMIT, 0)]
    rows = [[{(x["grp"], x["value"]): x["posterior"] for x in kept.collect()}, {x["source"]: (x["sensitivity"], x["specificity"]) for x in quality.collect()}] for kept, quality in sides]
    for a, b in zip(*rows):
        assert set(a) == set(b) and len(a) and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)


# segments


@pytest.mark.parametrize("t", ["", "a" * 5000, "word " * 3000, "# H\n" + "Sentence one. Two! Three? " * 400, "\r\n".join(text(8, i) for i in range(300)), "é\n" * 4000, text(30_000, 3)])
def test_split_round_trip(t):
    parts = segments.split(t)
    assert "".join(t[c:b] for _, c, b in parts) == t
    assert all(segments.tokens(t[a:b]) <= 350 for a, _, b in parts)
    assert all(a == 0 or 0 < c - a <= 160 for a, c, _ in parts[1:]) and all(c < b for _, c, b in parts if t)
    assert all(c <= a + 200 and a < c for a, c, _ in parts[1:])


def test_split_prefers_topic_boundaries():
    topic = lambda s: "\n".join(" ".join(random.Random(s * 100 + i).choices(VOCAB[s * 40 : s * 40 + 12], k=12)) for i in range(12))
    t = "\n\n## One\n".join(topic(s) for s in range(6))
    cuts = [c for _, c, _ in segments.split(t)[1:]]
    assert np.mean([t[c:].startswith("## ") for c in cuts]) > 0.7


def test_pieces(spark):
    rows = [(1, "x" * 1403, "t"), (2, "y " * 3000, "t"), (2, "y " * 3000, "t"), (3, None, "t"), (4, "", "t"), (5, "z" * 1404, "t")]
    df = spark.createDataFrame(rows, "id int, body string, text string")
    got = segments.pieces(df, ["id"], "body").collect()
    assert {r["id"] for r in got} == {2, 5} and len({(r["id"], r["piece"]) for r in got}) == len(got)
    assert segments.pieces(df.limit(0), ["id"], "body").count() == 0


# leaks


def test_leaks_equal_brute_force(spark):
    items = [(i, text(40, 500 + i) + f" costs {i + 3} euros.") for i in range(12)] + [(50, None), (51, "short one")]
    docs = []
    for i in range(60):
        t = text(80, 900 + i)
        if i % 3 == 0:
            part = items[i % 12][1].split()
            n = 8 + i % 10
            t += ". " + " ".join(part[5 : 5 + n]).upper() + ", " + text(10, i)
        docs.append((i, t, 7))
    docs += [(70, None, 7), (71, "", 7), (None, items[0][1], 7), docs[0], (72, text(50_000, 1) + " " + items[2][1], 7)]
    d = spark.createDataFrame(docs, "id int, text string, item_id int")
    e = spark.createDataFrame(items, "item_id int, text string")
    gram = lambda t: {tuple(w[i : i + 13]) for w in [W.words(t or "")] for i in range(len(w) - 12)}
    want = {(a, i) for a, t, _ in docs if a is not None for i, x in items if gram(t) & gram(x)}
    for limit in (leaks.BROADCAST_WINDOWS, 0):  # the looked-up and the shuffled way
        got = {(r["key"], r["item"]) for r in leaks.leaks(d, "id", "text", e, "item_id", "text", broadcast_windows=limit).where("exact > 0").collect()}
        assert got == want and len(want) > 8
    assert leaks.leaks(d.limit(0), "id", "text", e, "item_id", "text").count() == 0
    assert leaks.leaks(d, "id", "text", e.limit(0), "item_id", "text").count() == 0


def test_reworded_question_is_found(spark):
    q = "A train from Lisbon covers 120 km in 3 hours while a bus from Porto needs 5 hours for the same way home"
    good = q.replace("120", "250").replace("3 hours", "4 hours")
    mixed = q.replace("A train from Lisbon", "Some boat of Lisbon").replace("same way", "whole trip")
    d = spark.createDataFrame([(1, good), (2, mixed)], "id int, t string")
    got = {r["key"]: r for r in leaks.leaks(d, "id", "t", spark.createDataFrame([(9, q)], "i int, t string"), "i", "t").collect()}
    assert got[1]["reworded"] > 0
    assert leaks.consistent(["1", "x", "1"], ["2", "x", "2"]) and not leaks.consistent(["1", "x", "1"], ["2", "x", "3"])


@pytest.mark.parametrize("limit", [leaks.BROADCAST_WINDOWS, 0])  # all items at once, one at a time
def test_exchanged_name_that_no_item_holds_is_found(spark, limit):
    q = "A train from Lisbon covers 120 km in 3 hours while a bus from Porto needs 5 hours for the same way home"
    items = spark.createDataFrame([(9, q), (8, "We went by ship to Lisbon and to Porto. " + q)], "i int, t string")
    renamed = q.replace("Lisbon", "Bristol").replace("Porto", "Cork")
    rows = [(1, renamed), (2, "Found. " + renamed.replace("120", "250") + " x" * 40), (3, renamed.upper()), (4, q.lower()), (5, q.upper())]
    rows += [(6, q.replace("Lisbon", "there").replace("Porto", "here")), (7, renamed.replace("while", "when")), (10, renamed[:50]), (11, "x İx " + renamed)]
    d = spark.createDataFrame(rows, "id int, t string")
    got = {r["key"]: (r["exact"], r["reworded"]) for r in leaks.leaks(d, "id", "t", items, "i", "t", broadcast_windows=limit).where("item = 9").collect()}
    n = len(q.split()) - 12
    assert got == {1: (0, n), 2: (0, n), 3: (0, n), 4: (n, 0), 5: (n, 0), 11: (0, n)}


def test_runs_of_slots_and_tables_of_numbers(spark):
    """Slots are consistent over a whole run, and windows of placeholders count only as they are."""
    q = "we paid 40 euros for each of the 40 old chairs and then sold all of them on the market for 90 euros without any loss to us"
    other = q.replace("40", "55").replace("90", "70")
    torn = q.replace("paid 40", "paid 55").replace("the 40", "the 56").replace("90", "70")
    numbers = " ".join(str(1000 + i) for i in range(40))
    rows = [(1, other), (2, torn), (3, " ".join(str(7000 + i) for i in range(60))), (4, "see " + numbers + " here"), (5, q), (6, q.replace("90", "91"))]
    items = spark.createDataFrame([(9, q), (8, numbers)], "i int, t string")
    got = {(r["key"], r["item"]): (r["exact"], r["reworded"]) for r in leaks.leaks(spark.createDataFrame(rows, "id int, t string"), "id", "t", items, "i", "t").collect()}
    n = len(q.split()) - 12
    assert got[1, 9] == (0, n) and (2, 9) not in got and (3, 8) not in got and got[4, 8] == (28, 0) and got[5, 9] == (n, 0)
    assert sum(got[6, 9]) == n and min(got[6, 9]) > 0


@pytest.mark.parametrize("limit", [leaks.BROADCAST_WINDOWS, 0])
def test_reworded_equal_brute_force(spark, limit):
    """All windows, their runs and slots by plain loops."""
    r = random.Random(8)
    item = lambda i: " ".join(r.choice(VOCAB[:60]) if r.random() < 0.7 else r.choice([str(r.randrange(9)), "euros", "days"]) for _ in range(30))
    items = [(i, item(i)) for i in range(8)]
    docs = []
    for i in range(60):
        ws = items[i % 8][1].split()
        swap = {str(d): str(r.randrange(20, 29)) for d in range(9)} if i % 2 else {}
        part = [swap.get(w, w) for w in ws[r.randrange(6) : 20 + r.randrange(10)]]
        if i % 5 == 0:
            part[r.randrange(len(part))] = str(r.randrange(30, 39))
        docs.append((i, text(6, i) + " " + " ".join(part) + " " + text(6, 99 + i)))
    t = leaks.Template(())
    want = {}
    for d, dt in docs:
        b = W.words(dt)
        for i, it in items:
            a = W.words(it)
            exact = reworded = 0
            for apart in range(-len(b), len(a)):
                hits = []
                for p in range(len(b) - 12):
                    q = p + apart
                    if 0 <= q <= len(a) - 13:
                        x, y = a[q : q + 13], b[p : p + 13]
                        if x == y or [t.of(w) for w in x] == [t.of(w) for w in y] and sum(t.of(w) == w for w in x) >= 5:
                            hits.append((p, x == y))
                while hits:
                    run = [hits.pop(0)]
                    while hits and hits[0][0] - run[-1][0] <= 13:
                        run.append(hits.pop(0))
                    lo, hi = run[0][0], run[-1][0] + 13
                    exact += sum(e for _, e in run)
                    pairs = set(zip(a[lo + apart : hi + apart], b[lo:hi]))
                    if len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
                        reworded += sum(not e for _, e in run)
            if exact or reworded:
                want[d, i] = (exact, reworded)
    got = {(x["key"], x["item"]): (x["exact"], x["reworded"]) for x in leaks.leaks(spark.createDataFrame(docs, "id int, t string"), "id", "t", spark.createDataFrame(items, "i int, t string"), "i", "t", broadcast_windows=limit).collect()}
    assert got == want and sum(b > 0 for _, b in want.values()) > 5 and sum(a > 0 for a, _ in want.values()) > 5


# mixing


def test_mixing(spark):
    docs = [(i, "big" if i % 3 else "small", "letters " * (5 + i % 50)) for i in range(3000)]
    docs += [(9001, None, "x"), (None, "big", "x"), (9002, "big", None), (9003, "unused", "words " * 9), docs[5], (9004, "big", "")]
    df = spark.createDataFrame(docs, "id int, source string, text string").selectExpr("*", "1 as copies", "2 as tokens")
    aims = spark.createDataFrame([("big", 0.3, 1), ("small", 0.7, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mixed(df, "id", "source", "text", aims)
    s = {r["source"]: r for r in shares.collect()}
    rows = mix.collect()
    assert max(r["copies"] for r in rows) <= 3 and {r["source"] for r in rows} == {"big", "small"}
    assert s["gone"]["tokens"] == 0 and s["gone"]["documents"] == 0 and not s["gone"]["reached"]
    assert abs(s["big"]["actual_share"] - 0.3) < 0.01 and abs(s["small"]["actual_share"] - 0.7) < 0.01
    small = [r["copies"] for r in rows if r["source"] == "small"]
    assert max(small) - min(small) <= 1 and len(small) == 1000  # whole epochs before fractions
    assert sum(r["tokens"] * r["copies"] for r in rows if r["source"] == "big") == s["big"]["tokens"] <= s["big"]["budget"]
    # the same choice as one sort of a whole source
    weight = lambda t: max(0.05, sum(c.isalpha() for c in t) / max(1, len(t)))
    import hashlib

    key = lambda i, t: math.log((int(hashlib.md5(f"{i}:0".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight(t)
    big = sorted({(i, t) for i, src, t in docs if src == "big" and i is not None and t is not None}, key=lambda x: -key(*x))
    upto, want = 0, set()
    for i, t in big:
        upto += max(1, len(t) // 4)
        if upto <= s["big"]["budget"] - (0 if s["big"]["available"] > s["big"]["budget"] else s["big"]["available"]):
            want.add(i)
    if s["big"]["available"] > s["big"]["budget"]:
        assert {r["key"] for r in rows if r["source"] == "big"} == want
    empty, none = mixing.mixed(df.limit(0), "id", "source", "text", aims)
    assert empty.count() == 0 and none.count() == 3


def _plain_size(text, ranks):
    """Tokens of a text: pieces of the pattern, in each of which the pair of the lowest rank is merged again and again."""
    import regex

    from siftline.llm.tokens import PATTERN

    n = 0
    for piece in regex.findall(PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        n += len(parts)
    return n


def test_sizes_in_tokens():
    from siftline.llm.tokens import Tokenizer

    lines = Q._ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    tokenizer = Tokenizer(lines)
    odd = ["", "a", "It's 2024:  C++/C# \n\n\tfür   Straße, niño — 😀👍🏽 <|endoftext|>\x00\x1c x", "aé" * 40, "\r\n \r\n", "--" * 30 + " \u3000\u00a0x"]
    odd += [a + w + b for w in (" " * 1000, " " * 1300, "\n\t" * 700, "\u00a0 " * 600) for a, b in (("", ""), ("x", ""), ("", "y"), ("it's", "done 's"), ("1", "1"), ("\x1c", "\x1c."))]
    assert [tokenizer.size(t) for t in odd] == [_plain_size(t, ranks) for t in odd]
    assert tokenizer.size("x" + " " * 3_000_000 + "y") == tokenizer.size("x") + tokenizer.size(" " * 2_999_999) + tokenizer.size(" y")


def test_mixing_counts_tokens_of_the_tokenizer(spark):
    """Budgets, copies and shares are in tokens of the tokenizer: punctuation is far dearer in them than in characters."""
    from siftline.llm.tokens import Tokenizer

    docs = [(i, "prose", "the experience of the department " * (3 + i % 9)) for i in range(400)] + [(1000 + i, "marks", "«¿~¡» " * (3 + i % 9)) for i in range(400)]
    df = spark.createDataFrame([*docs, docs[0], (5000, "marks", None), (5001, "marks", "")], "id int, source string, text string")
    aims = spark.createDataFrame([("prose", 0.5, 2), ("marks", 0.5, 1)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mixed(df, "id", "source", "text", aims, ranks=Q._ranks())
    tokenizer = Tokenizer(Q._ranks())
    size = {i: max(1, tokenizer.size(t)) for i, _, t in [*docs, (5001, "", "")]}
    rows, s = mix.collect(), {r["source"]: r for r in shares.collect()}
    assert all(r["tokens"] == size[r["key"]] for r in rows)
    assert s["marks"]["available"] == sum(n for i, n in size.items() if i >= 1000) and s["marks"]["documents"] == 401
    assert abs(s["prose"]["actual_share"] - 0.5) < 0.01 and all(r["reached"] for r in s.values())
    by_characters = {r["source"]: r for r in mixing.mixed(df, "id", "source", "text", aims)[1].collect()}
    assert s["marks"]["available"] / s["prose"]["available"] > 2 * by_characters["marks"]["available"] / by_characters["prose"]["available"]


def test_texts_that_are_null_have_no_size(spark):
    df = spark.createDataFrame([(1, "a", "word " * 20), (2, "a", None), (3, "a", "")], "id int, source string, text string")
    aims = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mixed(df, "id", "source", "text", aims)
    assert sorted((r["key"], r["tokens"]) for r in mix.collect()) == [(1, 25), (3, 1)]
    assert [(r["documents"], r["available"]) for r in shares.collect()] == [(2, 26)]


# spam


def test_stuffed_pages(spark):
    say = lambda r: "When the {} of our {} was {}, we {} it for the {} and they have {} in a {}.".format(*r.sample(VOCAB, 7)) if r.random() < 0.5 else "{} and {} were {} by the {}, but not in the {} of {}.".format(*r.sample(VOCAB, 6))
    prose = [say(random.Random(i)) for i in range(120)]
    pages = [(i, "\n".join(random.Random(i).sample(prose, 8)), i) for i in range(60)]
    pages += [(100, "Jobs | " + " | ".join(random.Random(1).choices(VOCAB[:6], k=80)), 0), (101, " ".join(f"#{VOCAB[i % 9]}" for i in range(90)), 0), (102, "\n".join(f'<a href="https://x{i}.example/{VOCAB[i]}">{VOCAB[i].title()} jobs</a>' for i in range(40)), 0)]
    pages += [(103, prose[0] + "\n- " + "\n- ".join(w.title() for w in VOCAB[:5]) + "\n" + "\n".join(prose[3:9]), 0), (104, None, 0), (105, "", 0), (None, "x", 0), pages[0], (106, "# H\n*Acme — Town · 2020*\n" + prose[5], 0), (107, "kilo word " * 30_000, 0)]
    df = spark.createDataFrame(pages, "id int, text string, share int")
    got = {r["key"]: r for r in spam.stuffed_pages(df, "id", "text").collect()}
    assert {k for k, r in got.items() if r["stuffed"]} == {100, 101, 102, 107}
    assert got[105]["share"] == 0 and 104 not in got and len(got) == 67
    assert spam.stuffed_pages(df.limit(0), "id", "text").count() == 0


def test_encoded_lines_match():
    t = "One two, three.\n\n**Bold** [a](b) #x #x <br> 5.5\n> Two one two one"
    assert len(spam.encoded(t).split(bytes([spam.NEWLINE]))) == len(t.split("\n"))
